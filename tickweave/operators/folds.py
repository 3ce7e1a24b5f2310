"""Cross-validation folds as ranges of rows (fold_id, role, first, last), role being train or test, spelled out as (fold_id, row_idx, role) where rows are asked for."""

from __future__ import annotations

import random
import sys
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import with_prefix
from ..functions.stored import stored


def numbered(rows: DataFrame, order: tuple[str, ...] = ("timestamp",), ties: tuple[str, ...] = ("symbol", "bar_index", "bar_index_start")) -> DataFrame:
    """rows of all symbols with row_idx, their place in time; rows of one time go by the columns of ties that there are."""
    by = (*order, *[c for c in ties if c in rows.columns and c not in order])
    return with_prefix(rows.withColumn("_all", F.lit(0)), index="row_idx", keys=("_all",), order=by).drop("_all")


#: Rows that one array holds when ranges are spelled out.
STRETCH = 65_536


def rows_of(ranges: DataFrame) -> DataFrame:
    """(fold_id, row_idx, role) of ranges (fold_id, role, first, last); a long range becomes many tasks' rows, not one array."""
    starts = ranges.select("fold_id", "role", "last", F.explode(F.sequence("first", "last", F.lit(STRETCH).cast("long"))).alias("first"))
    return starts.select("fold_id", F.explode(F.sequence("first", F.least("last", F.col("first") + STRETCH - 1))).alias("row_idx"), "role")


def time_series_ranges(spark: SparkSession, total: int, n_splits: int, test_size: int | None = None, gap: int = 0) -> DataFrame:
    """(fold_id, role, first, last): of rows numbered from 0, tests are the last n_splits blocks of test_size in order; what comes before a
    block, but for a gap, trains it."""
    size = test_size or total // (n_splits + 1)
    starts = [total - (n_splits - i) * size for i in range(n_splits)]
    if size < 1 or starts[0] - gap <= 0:
        raise ValueError(f"too few rows for {n_splits} splits: {total}")
    parts = [(i, role, a, b) for i, at in enumerate(starts) for role, a, b in (("train", 0, at - gap - 1), ("test", at, at + size - 1))]
    return spark.createDataFrame(parts, "fold_id int, role string, first long, last long")


def time_series_folds(rows: DataFrame, n_splits: int, test_size: int | None = None, gap: int = 0) -> DataFrame:
    """time_series_ranges() of so many rows, spelled out."""
    return rows_of(time_series_ranges(rows.sparkSession, rows.count(), n_splits, test_size, gap))


def group_of(row_idx, total, n_groups: int):
    """The contiguous block of a row; the first total % n_groups blocks have one row more."""
    small, more = F.floor(total / n_groups), total % n_groups
    edge = more * (small + 1)
    return F.when(row_idx < edge, F.floor(F.try_divide(row_idx, small + 1))).otherwise(more + F.floor(F.try_divide(row_idx - edge, small))).cast("int")


def cpcv_groups(rows: DataFrame, n_groups: int) -> DataFrame:
    total = rows.agg(F.count("*").alias("total"))
    return rows.join(F.broadcast(total)).withColumn("group_id", group_of(F.col("row_idx"), F.col("total"), n_groups)).drop("total")


def n_combinations(n_groups: int, n_test: int, limit: int | None = None) -> int:
    return min(comb(n_groups, n_test), limit or comb(n_groups, n_test))


def combination_at(place: int, n_groups: int, n_test: int) -> tuple[int, ...]:
    """The choice of n_test of n_groups at this place in lexicographic order."""
    out, group = [], 0
    for left in range(n_test, 0, -1):
        while place >= (after := comb(n_groups - group - 1, left - 1)):  # choices that begin with this group
            place, group = place - after, group + 1
        out.append(group)
        group += 1
    return tuple(out)


def cpcv_combinations(n_groups: int, n_test: int, limit: int | None = None, seed: int = 42) -> list[tuple[int, ...]]:
    """Every choice of n_test groups, or a seeded sample of them in order; a sample is made from drawn places, without listing all."""
    total = comb(n_groups, n_test)
    if not limit or limit >= total:
        return list(combinations(range(n_groups), n_test))
    rng = random.Random(seed)
    if total <= sys.maxsize:
        places = rng.sample(range(total), limit)
    else:
        places = set()
        while len(places) < limit:
            places.add(rng.randrange(total))
    return [combination_at(i, n_groups, n_test) for i in sorted(places)]


def group_ranges(total: int, n_groups: int) -> list[tuple[int, int]]:
    """First and last row of each block of group_of(); of those that have rows."""
    small, more = divmod(total, n_groups)
    firsts = [i * small + min(i, more) for i in range(n_groups + 1)]
    return [(a, b - 1) for a, b in zip(firsts, firsts[1:], strict=False) if b > a]


def _outside(taken: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """What ranges of rows leave of 0 .. total - 1."""
    out, at = [], 0
    for first, last in sorted(taken):
        if first > at:
            out.append((at, min(first, total) - 1))
        at = max(at, last + 1)
    return [*out, (at, total - 1)] if at < total else out


def _runs(groups: tuple[int, ...]) -> list[list[int]]:
    """Neighbouring groups together."""
    out: list[list[int]] = []
    for g in groups:
        if out and out[-1][-1] == g - 1:
            out[-1].append(g)
        else:
            out.append([g])
    return out


def _require_order(rows: DataFrame) -> None:
    blocked = rows.select("row_idx", "start_idx", F.floor(F.col("row_idx") / STRETCH).alias("_block"))
    back = blocked.withColumn("back", F.lag("start_idx").over(Window.partitionBy("_block").orderBy("row_idx")) > F.col("start_idx"))
    edges = back.groupBy("_block").agg(F.max("back").alias("back"), F.min_by("start_idx", "row_idx").alias("first"), F.max_by("start_idx", "row_idx").alias("last"))
    over = F.lag("last").over(Window.orderBy("_block")) > F.col("first")  # a row for each block
    if not edges.withColumn("over", over).where("back or over").isEmpty():
        raise ValueError("rows must be numbered in order of start_idx")


def cpcv_ranges(rows: DataFrame, n_groups: int, n_test: int, embargo: int = 0, limit: int | None = None, purge: str = "envelope", seed: int = 42) -> DataFrame:
    """(fold_id, role, first, last): combinatorial purged folds of rows (row_idx from 0, start_idx, end_idx) as ranges of row_idx.

    Train rows within `embargo` rows after a run of test rows are left out, then those whose [start_idx, end_idx] meets the labels of the
    test rows: one envelope over all of them, or (`per_run`) one for each run. Folds without a train or a test row are left out. Rows
    are numbered in order of start_idx, so that those that start within a span are a range; only rows that start before a
    span and reach into it are looked for one by one. Without those the table has a few ranges for each fold, however many rows there are.
    """
    if purge not in ("envelope", "per_run"):
        raise ValueError(f"unknown purge: {purge}")
    spark = rows.sparkSession
    rows = stored(rows.select("row_idx", "start_idx", "end_idx"), "rows")
    _require_order(rows)
    total, kinds = rows.count(), dict(rows.dtypes)
    groups = group_ranges(total, n_groups)
    grouped = rows.withColumn("group_id", group_of(F.col("row_idx"), F.lit(total), n_groups))
    spans = {r["group_id"]: (r["low"], r["high"]) for r in grouped.groupBy("group_id").agg(F.min("start_idx").alias("low"), F.max("end_idx").alias("high")).collect()}  # n_groups rows
    counted = rows.agg(*[F.count_if(F.col("start_idx") < F.lit(low)).alias(f"before_{g}") for g, (low, _) in spans.items()], *[F.count_if(F.col("start_idx") <= F.lit(high)).alias(f"upto_{g}") for g, (_, high) in spans.items()]).first() if groups else {}

    def held(choice: tuple[int, ...]) -> tuple[list, list, list[int]]:
        """(test ranges, all ranges that are no train rows, the groups whose start other labels may reach over)."""
        runs = _runs(tuple(g for g in choice if g < len(groups)))
        tests = [(groups[r[0]][0], groups[r[-1]][1]) for r in runs]
        taken, lows = [(a, b + embargo) for a, b in tests], []
        for span in runs if purge == "per_run" else [[g for r in runs for g in r]] if runs else []:
            first, last = min(span, key=lambda g: spans[g][0]), max(span, key=lambda g: spans[g][1])
            taken.append((counted[f"before_{first}"], counted[f"upto_{last}"] - 1))
            lows.append(first)
        return tests, taken, lows

    tests, trains, reach = [], [], []
    for fold, choice in enumerate(cpcv_combinations(n_groups, n_test, limit, seed)):
        own, taken, lows = held(choice)
        tests += [(fold, "test", a, b) for a, b in own]
        trains += [(fold, a, b) for a, b in _outside(taken, total)]
        reach += [(fold, g) for g in lows]
    # rows that start before a group and reach into it, in stretches
    starts = F.array(*[F.struct(F.lit(g).alias("group_id"), F.lit(low).cast(kinds["start_idx"]).alias("low")) for g, (low, _) in spans.items()]) if spans else F.array().cast(f"array<struct<group_id int, low {kinds['start_idx']}>>")
    into = rows.select("row_idx", F.explode(F.filter(starts, lambda x: (F.col("start_idx") < x["low"]) & (F.col("end_idx") >= x["low"]))).alias("x")).select("row_idx", "x.group_id")
    stretch = F.col("row_idx") - F.row_number().over(Window.partitionBy("group_id", F.floor(F.col("row_idx") / STRETCH)).orderBy("row_idx"))
    into = into.withColumns({"_s": stretch, "_b": F.floor(F.col("row_idx") / STRETCH)}).groupBy("group_id", "_b", "_s").agg(F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))
    gone = into.join(F.broadcast(spark.createDataFrame(reach, "fold_id int, group_id int")), "group_id")  # one row for each fold and span
    steps = lambda df, t, x: df.select("fold_id", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).select("fold_id", "e.at", (F.col("e.d") * t).alias("t"), (F.col("e.d") * x).alias("x"))
    edges = steps(spark.createDataFrame(trains, "fold_id int, first long, last long"), 1, 0).unionByName(steps(gone, 0, 1)).groupBy("fold_id", "at").agg(F.sum("t").alias("t"), F.sum("x").alias("x"))
    by = Window.partitionBy("fold_id").orderBy("at")
    kept = edges.select("fold_id", F.col("at").alias("first"), (F.lead("at").over(by) - 1).alias("last"), ((F.sum("t").over(by) > 0) & (F.sum("x").over(by) == 0)).alias("kept")).where("kept")
    new = F.coalesce((F.col("first") != F.lag("last").over(Window.partitionBy("fold_id").orderBy("first")) + 1).cast("int"), F.lit(1))
    merged = kept.withColumn("_new", new).withColumn("_range", F.sum("_new").over(Window.partitionBy("fold_id").orderBy("first"))).groupBy("fold_id", "_range").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    train = stored(merged.select("fold_id", F.lit("train").alias("role"), "first", "last"), "train")
    test = spark.createDataFrame(tests, "fold_id int, role string, first long, last long")
    both = train.select("fold_id").distinct().join(F.broadcast(test.select("fold_id").distinct()), "fold_id")  # a row for each fold
    return train.unionByName(test).join(F.broadcast(both), "fold_id", "left_semi")


def cpcv_folds(rows: DataFrame, n_groups: int, n_test: int, embargo: int = 0, limit: int | None = None, purge: str = "envelope", seed: int = 42) -> DataFrame:
    """cpcv_ranges(), spelled out: a row for each row and fold."""
    return rows_of(cpcv_ranges(rows, n_groups, n_test, embargo, limit, purge, seed))
