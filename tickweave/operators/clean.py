"""Cleaning and filtering of ticks. Order is always (timestamp, seq) within a symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import with_prefix
from ..functions.windows import in_blocks
from ..schema import nan_to_null


def cast_timestamp(ticks: DataFrame) -> DataFrame:
    """Whole milliseconds since 1970 become a timestamp; a timestamp stays."""
    kind = dict(ticks.dtypes)["timestamp"]
    if kind in ("bigint", "int"):
        return ticks.withColumn("timestamp", F.timestamp_millis(F.col("timestamp").cast("long")))
    return ticks.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def positive_prices(ticks: DataFrame) -> DataFrame:
    return ticks.where("askPrice > 0 AND bidPrice > 0")


def ordered_quotes(ticks: DataFrame) -> DataFrame:
    return ticks.where("askPrice >= bidPrice")


def validate_and_clean(ticks: DataFrame) -> DataFrame:
    """Known columns and types, positive prices, no negative spread."""
    from .validate import require_ticks

    require_ticks(ticks)
    return ordered_quotes(positive_prices(cast_timestamp(nan_to_null(ticks))))


def dedupe(ticks: DataFrame) -> DataFrame:
    """The first tick by seq of each timestamp."""
    w = Window.partitionBy("symbol", "timestamp").orderBy("seq")
    return ticks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_zero_spread(ticks: DataFrame) -> DataFrame:
    return ticks.where("askPrice - bidPrice > 0")


def drop_outliers(ticks: DataFrame, window: int = 50, threshold: float = 3.0, price: str = "bidPrice") -> DataFrame:
    """Without ticks whose price lies more than `threshold` deviations off the mean of the last `window` ticks, itself included."""

    def scored(df: DataFrame, f) -> DataFrame:
        over = f.roll(window)
        z = F.abs(F.col(price) - F.avg(price).over(over)) / (F.stddev_samp(price).over(over) + 1e-10)
        return df.withColumn("_z", z)

    numbered = with_prefix(ticks, index="bar_index")
    return in_blocks(numbered, scored, window).where(~F.coalesce(F.col("_z") > threshold, F.lit(False))).select(*ticks.columns)


def clean_ticks(ticks: DataFrame, window: int = 50, threshold: float = 3.0) -> DataFrame:
    return drop_outliers(drop_zero_spread(dedupe(ticks)), window, threshold)


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold no value at all. One aggregate."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def training_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows in which every feature is defined."""
    return df.na.drop("any", subset=features)


def feature_columns(df: DataFrame, keys: tuple[str, ...] = ("symbol", "bar_index", "timestamp")) -> list[str]:
    """Numeric columns that are neither keys nor labels: no label column is ever a feature."""
    from ..schema import LABEL_COLUMNS

    numeric = {"double", "float", "int", "bigint"}
    return [c for c, kind in df.dtypes if kind in numeric and c not in keys and c not in LABEL_COLUMNS]


def common_features(train: DataFrame, test: DataFrame) -> list[str]:
    return sorted(set(feature_columns(train)) & set(feature_columns(test)))


def chain(df: DataFrame, *steps) -> DataFrame:
    return reduce(lambda d, s: s(d), steps, df)
