"""Exact quantiles by selection: no task ever holds all values of a key.

A sketch of bounded size cuts each key's values into ranges. The wanted order statistics lie in a few neighbouring ranges for sure, as
the sketch's error is far below a range; the others are only counted. Where what is left is still large, it is cut again.
Then its distinct values are counted and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Ranges of a cut, and the sketch's accuracy in parts of a range.
RANGES, PARTS = 512, 20

#: Values between a key's bounds that are ranked in one task.
RANKED = 1_000_000


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column | str, float]], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and a column for each alias -> (values, share): the share's quantile of the values, between two of them by linear interpolation.

    Null values and NaN don't count; without values a quantile is null. There is a row for each key of df, null keys too, and one row
    if there are no keys, even of an empty table.
    """
    names = list(wanted)
    of = {k: f"_k{i}" for i, k in enumerate(keys)}
    cells = [F.struct(F.lit(i).alias("which"), F.lit(float(share)).alias("share"), F.nanvl((F.col(v) if isinstance(v, str) else v).cast("double"), F.lit(None)).alias("x")) for i, (v, share) in enumerate(wanted.values())]
    own = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("!")).alias(g) for k, g in of.items()]
    rows = df.select(*own, F.explode(F.array(*cells)).alias("c")).select(*of.values(), "c.*").where("x is not null")
    group = [*of.values(), "which"]
    known, inside = None, rows
    while True:
        # known: of each key and quantile the bounds so far, how many values there are in all, and how many below the bounds; inside: those between
        cuts = inside.groupBy(*group, "share").agg(F.count("*").alias("n"), F.percentile_approx("x", [i / RANGES for i in range(RANGES + 1)], RANGES * PARTS).alias("cuts"))
        cuts = cuts.join(known, group) if known is not None else cuts.withColumns({"total": F.col("n"), "before": F.lit(0).cast("long"), "low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
        rank = F.col("share") * (F.col("total") - 1) - F.col("before")
        first = F.floor((F.floor(rank) + 1) / F.col("n") * RANGES) - 1
        last = F.ceil((F.ceil(rank) + 1) / F.col("n") * RANGES) + 1
        cut = lambda i: F.element_at("cuts", i.cast("int") + 1)
        bounds = cuts.select(*group, "total", F.when(first > 0, cut(first)).otherwise(F.col("low")).alias("low"), F.when(last < RANGES, cut(last)).otherwise(F.col("high")).alias("high"), F.col("n").alias("held"))
        bounds = stored(bounds, "bounds")
        met = rows.join(bounds, group)
        counted = met.groupBy(*group).agg(F.count_if(F.col("x") < F.col("low")).alias("before"), F.count_if(F.col("x").between(F.col("low"), F.col("high"))).alias("now"))
        counted = stored(counted.join(bounds, group), "counted")
        inside = met.where(F.col("x").between(F.col("low"), F.col("high"))).select(*group, "share", "x")
        known = counted.select(*group, "total", "before", "low", "high")
        # where a cut leaves nearly all, they are few values that many rows have
        most = counted.where(F.col("now") < 0.9 * F.col("held")).agg(F.max("now")).first()[0]
        if most is None or most <= RANKED:
            break
    values = inside.groupBy(*group, "share", "x").agg(F.count("*").alias("n")).join(known.select(*group, "total", "before"), group)
    upto = values.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*group).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("share") * (F.col("total") - 1)
    holds = lambda rank: (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
    found = upto.groupBy(*group, "share", "total").agg(F.max(F.when(holds(F.floor(place)), F.col("x"))).alias("a"), F.max(F.when(holds(F.ceil(place)), F.col("x"))).alias("b"))
    found = found.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place)))
    wide = found.groupBy(*of.values()).agg(*[F.max(F.when(F.col("which") == i, F.col("q"))).alias(name) for i, name in enumerate(names)])
    if not keys:
        return wide
    every = df.select(*keys).distinct().select("*", *own)
    return every.join(wide, list(of.values()), "left").select(*keys, *names)
