"""Row numbers and running sums in two levels: within a time bucket, then over the buckets' totals.

A symbol's ticks never have to meet in one task: rows are sorted within (symbol, bucket), and only one row for each
bucket takes part in the window over buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_prefix(df: DataFrame, sums: dict[str, str] | None = None, index: str | None = None, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("timestamp", "seq"), bucket: str = "day") -> DataFrame:
    """Adds running sums (alias -> column, the row included) and, if named, the row's number from 0 in the order of a key."""
    sums = sums or {}
    # keys without nulls, so that window, totals and join agree on one hash partitioning and the rows move once
    group = [f"_k{i}" for i in range(len(keys))]
    parts = {g: F.coalesce(F.col(k).cast("string"), F.lit("!")) for g, k in zip(group, keys, strict=True)}
    # one exchange, read by the totals and by the window: what comes before it runs once
    bucketed = df.withColumns(parts | {"_bucket": F.coalesce(F.date_trunc(bucket, order[0]).cast("string"), F.lit("!"))}).repartition(*group, "_bucket")
    totals = bucketed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{a}") for a, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_t_{a}").over(before), F.lit(0)).alias(f"_b_{a}") for a in sums])
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = bucketed.withColumns({f"_r_{a}": F.sum(c).over(running) for a, c in sums.items()} | ({"_row": F.row_number().over(inside)} if index else {}))
    joined = own.join(totals, [*group, "_bucket"])
    out = [F.col(c) for c in df.columns] + [(F.col(f"_b_{a}") + F.col(f"_r_{a}")).alias(a) for a in sums]
    if index:
        out.append((F.col("_before") + F.col("_row") - 1).cast("long").alias(index))
    return joined.select(*out)


#: Ranges of values that are numbered apart.
RANGES = 256


def value_places(values: DataFrame, column: str, n: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct non-null values with `before`: the sum of n over all smaller ones. Ranges of values between quantiles run apart."""
    cuts = values.agg(F.percentile_approx(column, [i / RANGES for i in range(1, RANGES)], 100 * RANGES).alias("_cuts"))
    dealt = values.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")  # one row of cuts
    totals = dealt.groupBy("_range").agg(F.sum(n).alias("_total"))
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # RANGES rows
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(totals), "_range").select(column, n, *keep, (F.col("_base") + F.col("_inside")).cast("long").alias("before"))
