"""Experiment records and models on storage: append-only tables, written and listed by Spark."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, kind string, key string, value string, at timestamp"

#: Where a model may lie.
SCHEMES = ("runs:/", "models:/", "file://", "hdfs://", "s3a://", "/")

_models: dict[str, PipelineModel] = {}


def record(spark: SparkSession, path: str, run_id: str, params: dict | None = None, metrics: dict | None = None, artifacts: dict | None = None) -> None:
    """Append a run's params, metrics and artifacts."""
    rows = [(run_id, kind, k, str(v)) for kind, part in (("param", params), ("metric", metrics), ("artifact", artifacts)) for k, v in (part or {}).items()]
    spark.createDataFrame(rows, "run_id string, kind string, key string, value string").withColumn("at", F.timestamp_micros(F.lit(int(time.time() * 1e6)))).write.mode("append").parquet(path)


def list_runs(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """Runs that have a model, newest first."""
    runs = spark.read.schema(RUNS).parquet(path)
    with_model = runs.where("kind = 'artifact' AND key = 'model'").groupBy("run_id").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("model"))
    return with_model.orderBy(F.desc("at"), "run_id").limit(limit)


def load_model(uri: str) -> PipelineModel:
    if not uri.startswith(SCHEMES):
        raise ValueError(f"not the place of a model: {uri}")
    if uri not in _models:
        _models[uri] = PipelineModel.load(uri.removeprefix("file://") if uri.startswith("file://") else uri)
    return _models[uri]


def loaded_models() -> list[str]:
    return sorted(_models)


def forget_models() -> None:
    _models.clear()


def write_csv(df: DataFrame, path: str) -> None:
    """A small result (a trade log, a comparison) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def rows_from(spark: SparkSession, features: list[dict]) -> DataFrame:
    """Feature maps of a request as rows; all values are doubles, missing ones null."""
    if not features:
        raise ValueError("no features were given")
    names = sorted({k for f in features for k in f})
    data = [tuple(None if f.get(n) is None else float(f[n]) for n in names) for f in features]
    return spark.createDataFrame(data, ", ".join(f"`{n}` double" for n in names))
