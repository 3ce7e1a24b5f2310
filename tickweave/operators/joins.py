"""Joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, columns: list[str], direction: str = "nearest", at: str = "timestamp", key: str = "symbol", bucket: str = "day") -> DataFrame:
    """left with `columns` of right's row nearest in time (of equals the later one), or the last before, or the first after.

    Both sides are merged in time order within (key, bucket); what lies in other buckets comes from a table with each
    bucket's first and last right row, so no key has to pass one task. right's times are taken as distinct within a key.
    """
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    payload = F.struct(F.col(at).alias("_t"), *columns)
    b = F.date_trunc(bucket, at)
    rows = left.select(key, at, b.alias("_b"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_right"))
    rows = rows.unionByName(right.select(key, at, b.alias("_b"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_left"), payload.alias("_right")))
    # right rows stand before left rows of the same time when looking back, and after them when looking ahead
    back = Window.partitionBy(key, "_b").orderBy(at, F.col("_right").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key, "_b").orderBy(F.col(at).desc(), F.col("_right").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(key, "_b").agg(F.min_by("_right", F.when(F.col("_right").isNotNull(), F.col(at))).alias("first"), F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col(at))).alias("last"))
    w = Window.partitionBy(key).orderBy("_b")
    ends = ends.select(key, "_b", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    seen = rows.withColumns({"_p": F.last("_right", True).over(back), "_n": F.last("_right", True).over(ahead)}).where("_left IS NOT NULL").join(ends, [key, "_b"], "left")
    p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    gap = lambda x, y: F.unix_micros(x) - F.unix_micros(y)
    nearest = F.when(p.isNull(), n).when(n.isNull(), p).when(gap(n["_t"], F.col(at)) <= gap(F.col(at), p["_t"]), n).otherwise(p)
    pick = {"backward": p, "forward": n, "nearest": nearest}[direction]
    return seen.select("_left.*", pick.alias("_x")).select(*left.columns, *[F.col(f"_x.{c}").alias(c) for c in columns])


def common_rows(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_semi")


def intervals_of(rows: DataFrame, intervals: DataFrame, on: list[str]) -> DataFrame:
    """The label intervals (start_idx, end_idx) of rows by key."""
    return rows.join(intervals.select(*on, "start_idx", "end_idx"), on)
