"""Random forests on feature tables: balanced weights, calibration, importances, cross-validation over fold tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .performance import classification


@dataclass(frozen=True)
class ForestSpec:
    n_trees: int = 100
    max_depth: int = 8
    min_leaf: int = 1
    balanced: bool = True
    seed: int = 42

    @staticmethod
    def from_config(config: dict) -> ForestSpec:
        kind = config.get("backend", "cpu")
        if kind not in ("cpu", "sklearn", "gpu", "cuml", "spark"):
            raise ValueError(f"unknown model backend: {kind}")
        return ForestSpec(config["n_estimators"], config["max_depth"], config.get("min_samples_leaf", 1), config.get("class_weight", "balanced") == "balanced", config.get("random_state", 42))


def with_class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """weight = rows / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)  # a row for each class


def fit_forest(rows: DataFrame, features: list[str], spec: ForestSpec = ForestSpec(), label: str = "label", positive: int = 1) -> PipelineModel:
    """Rows with undefined features are left out."""
    ready = rows.na.drop("any", subset=features).withColumn("_y", (F.col(label) == positive).cast("double"))
    ready = with_class_weights(ready, "_y") if spec.balanced else ready.withColumn("weight", F.lit(1.0))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="weight", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_class", numTrees=spec.n_trees, maxDepth=spec.max_depth, minInstancesPerNode=spec.min_leaf, seed=spec.seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"), forest]).fit(ready)


def predict(model: PipelineModel, rows: DataFrame, positive: int = 1, negative: int = -1) -> DataFrame:
    """rows with probability (of positive) and prediction; rows with undefined features are left out."""
    out = model.transform(rows).withColumn("probability", vector_to_array("_p")[1])
    return out.withColumn("prediction", F.when(F.col("_class") == 1.0, positive).otherwise(negative)).drop("_x", "_p", "_raw", "_class")


def confidence(probability: str = "probability"):
    p = F.greatest(F.col(probability), 1 - F.col(probability))
    return F.when(p >= 0.8, "high").when(p >= 0.6, "medium").otherwise("low")


def calibrate(scored: DataFrame, method: str = "isotonic", label: str = "label", positive: int = 1):
    """A fitted map from probability to calibrated probability, from rows that the forest was not trained on."""
    rows = scored.withColumn("_y", (F.col(label) == positive).cast("double"))
    if method == "isotonic":
        return IsotonicRegression(featuresCol="probability", labelCol="_y", predictionCol="calibrated").fit(rows)
    if method == "sigmoid":
        return Pipeline(stages=[VectorAssembler(inputCols=["probability"], outputCol="_s"), LogisticRegression(featuresCol="_s", labelCol="_y", probabilityCol="_cal", rawPredictionCol="_calraw", predictionCol="_calclass")]).fit(rows)
    raise ValueError(f"unknown calibration: {method}")


def calibrated(model, scored: DataFrame) -> DataFrame:
    out = model.transform(scored)
    return out if "calibrated" in out.columns else out.withColumn("calibrated", vector_to_array("_cal")[1]).drop("_s", "_cal", "_calraw", "_calclass")


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


#: Folds whose models are fitted at the same time.
FITS = 4


def fit_folds(rows: DataFrame, folds: DataFrame, features: list[str], spec: ForestSpec = ForestSpec(), label: str = "label", positive: int = 1, extra: DataFrame | None = None) -> dict[int, PipelineModel]:
    """A model for each fold, from its train rows; folds and rows meet on row_idx. Folds without both classes have none.

    extra has features of rows that differ from fold to fold, by fold_id and row_idx.

    Fits don't depend on each other and are submitted from several threads, so that small folds fill the cluster.
    """
    ready = rows.na.drop("any", subset=[f for f in features if f in rows.columns])
    train = ready.join(folds.where("role = 'train'").select("fold_id", "row_idx"), "row_idx")
    train = train if extra is None else train.join(extra, ["fold_id", "row_idx"])
    usable = train.groupBy("fold_id").agg(F.count_distinct(F.col(label) == positive).alias("n")).where("n = 2")
    ids = [r["fold_id"] for r in usable.orderBy("fold_id").collect()]
    with ThreadPoolExecutor(FITS) as pool:
        return dict(zip(ids, pool.map(lambda k: fit_forest(train.where(F.col("fold_id") == k), features, spec, label, positive), ids), strict=True))


def score_folds(models: dict[int, PipelineModel], rows: DataFrame, folds: DataFrame, positive: int = 1, negative: int = -1, extra: DataFrame | None = None) -> DataFrame:
    """The test rows of each fold that has a model, with fold_id, probability and prediction; extra as in fit_folds()."""
    tests = rows.join(folds.where("role = 'test'").select("fold_id", "row_idx"), "row_idx")
    tests = tests if extra is None else tests.join(extra, ["fold_id", "row_idx"])
    if not models:
        return tests.withColumns({"probability": F.lit(None).cast("double"), "prediction": F.lit(None).cast("int")}).limit(0)
    parts = [predict(model, tests.where(F.col("fold_id") == k), positive, negative) for k, model in models.items()]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(rows: DataFrame, folds: DataFrame, features: list[str], spec: ForestSpec = ForestSpec(), label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(metrics of each fold, all test rows scored)."""
    scored = score_folds(fit_folds(rows, folds, features, spec, label), rows, folds)
    return classification(scored, label, keys=("fold_id",)), scored


def meta_training_rows(scored: DataFrame) -> DataFrame:
    """Scored rows with primary_proba and meta_label, for the model that says whether a trade pays."""
    return scored.withColumns({"primary_proba": F.col("probability"), "meta_label": (F.col("pnl") > 0).cast("int")}).drop("probability", "prediction")
