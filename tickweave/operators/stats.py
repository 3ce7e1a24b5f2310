"""Tests of two samples of returns. Sums, moments and ranks are aggregates; only a handful of numbers reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import poisson_weights, resamples
from ..functions.prefix import value_places
from ..functions.quantiles import exact_quantiles
from ..functions.stored import stored

ALTERNATIVES = ("two-sided", "greater", "less")


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1, 300):
        m = i // 2
        n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-30)
        c = 1 + n / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front / f


def t_tail(t: float, df: float) -> float:
    """P(T > t)."""
    half = beta_share(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def _p(upper: float, lower: float, alternative: str) -> float:
    return {"greater": upper, "less": lower, "two-sided": min(1.0, 2 * min(upper, lower))}[alternative]


def t_statistic(model: DataFrame, baseline: DataFrame, column: str = "pnl") -> DataFrame:
    """One row: pooled two-sample t, degrees of freedom and both means."""
    both = model.select(F.col(column).alias("x"), F.lit(True).alias("m")).unionByName(baseline.select(F.col(column).alias("x"), F.lit(False).alias("m")))
    a, b = (lambda f, c=c: f(F.when(c, F.col("x"))) for c in (F.col("m"), ~F.col("m")))
    s = both.agg(a(F.count).alias("n1"), b(F.count).alias("n2"), a(F.avg).alias("mean1"), b(F.avg).alias("mean2"), a(F.var_samp).alias("v1"), b(F.var_samp).alias("v2"))
    pooled = ((F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("v2", F.lit(0.0))) / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0))
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled * (1 / F.nullif("n1", F.lit(0)) + 1 / F.nullif("n2", F.lit(0)))))
    return s.select("n1", "n2", "mean1", "mean2", t.alias("t"), (F.col("n1") + F.col("n2") - 2).alias("df"))


def t_test(model: DataFrame, baseline: DataFrame, column: str = "pnl", alternative: str = "two-sided") -> dict:
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unknown alternative: {alternative}")
    r = t_statistic(model, baseline, column).first()
    if not r["n1"] or not r["n2"] or r["t"] is None:
        return {"t": 0.0, "p_value": 1.0, "difference": 0.0}
    return {"t": r["t"], "p_value": _p(t_tail(r["t"], r["df"]), t_tail(-r["t"], r["df"]), alternative), "difference": r["mean1"] - r["mean2"]}


def mann_whitney_statistic(model: DataFrame, baseline: DataFrame, column: str = "pnl") -> DataFrame:
    """One row: U of the first sample with mean ranks for ties, sizes, the ties' correction, medians.

    Ranks come from counts of distinct values, not of rows, so many equal returns cost as much as one; ranges of values are
    ranked apart.
    """
    both = model.select(F.col(column).alias("x"), F.lit(1).alias("m")).unionByName(baseline.select(F.col(column).alias("x"), F.lit(0).alias("m"))).where("x IS NOT NULL")
    both = stored(both, "samples")  # read by several passes
    values = both.groupBy("x").agg(F.sum("m").alias("a"), F.sum(1 - F.col("m")).alias("b"))
    n = F.col("a") + F.col("b")
    ranked = value_places(values.withColumn("n", n), "x", "n", ("a", "b")).withColumn("rank", F.col("before") + (n + 1) / 2)
    u = F.sum(F.col("a") * F.col("rank")) - F.sum("a") * (F.sum("a") + 1) / 2
    s = ranked.agg(u.alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.pow(n, 3) - n).alias("ties"))
    med = exact_quantiles(both, {f"median{i}": (F.when(F.col("m") == m, F.col("x")), 0.5) for i, m in ((1, 1), (2, 0))})
    return s.join(F.broadcast(med))  # one row each


#: p values are exact where one sample has at most so many values, no two are equal, and U has at most so many values.
EXACT_SIZE, EXACT_VALUES = 8, 10_000_000


def u_shares(n1: int, n2: int) -> np.ndarray:
    """P(U <= u) for u = 0 .. n1 n2 if all orders of n1 and n2 unlike values are equally likely.

    Orders with U = u are partitions of u into at most n1 parts of at most n2: one factor (1 - x^(n2 + i)) / (1 - x^i) after another, each
    scaled so that shares add up to 1.
    """
    few, many = sorted((n1, n2))
    shares = np.zeros(n1 * n2 + 1)
    shares[0] = 1.0
    for i in range(1, few + 1):
        shares[many + i :] -= shares[: max(0, len(shares) - many - i)].copy()
        for at in range(i):  # sums of every i-th share
            shares[at::i] = np.cumsum(shares[at::i])
        shares *= i / (many + i)
    return np.cumsum(np.maximum(shares, 0.0))


def mann_whitney(model: DataFrame, baseline: DataFrame, column: str = "pnl", alternative: str = "two-sided") -> dict:
    """p values are exact for small samples without ties (see EXACT_SIZE), else a tie-corrected normal approximation with continuity correction."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unknown alternative: {alternative}")
    r = mann_whitney_statistic(model, baseline, column).first()
    n1, n2 = r["n1"] or 0, r["n2"] or 0
    out = {"u": r["u"], "median1": r["median1"], "median2": r["median2"], "method": "normal"}
    if not n1 or not n2:
        return out | {"u": 0.0, "p_value": 1.0}
    if not r["ties"] and min(n1, n2) <= EXACT_SIZE and n1 * n2 <= EXACT_VALUES:
        shares = u_shares(n1, n2)
        below = lambda u: float(shares[round(u)])
        return out | {"p_value": _p(below(n1 * n2 - r["u"]), below(r["u"]), alternative), "method": "exact"}
    n = n1 + n2
    sd = sqrt(n1 * n2 / 12 * ((n + 1) - r["ties"] / (n * (n - 1))))
    tail = lambda u: erfc((u - n1 * n2 / 2 - 0.5) / sd / sqrt(2)) / 2 if sd else 1.0
    return out | {"p_value": _p(min(1.0, tail(r["u"])), min(1.0, tail(n1 * n2 - r["u"])), alternative)}


#: Statistics of a resample from its sums of weights w, w x and w x^2; the median is found otherwise.
_OF_SUMS = {"mean": lambda w, s, q: s / w, "sharpe": lambda w, s, q: F.try_divide(s / w, F.sqrt(F.greatest(q / w - F.pow(s / w, 2), F.lit(0.0)))) * sqrt(252)}
STATISTICS = (*_OF_SUMS, "median")

#: Runs of values, each with about as many rows, between which a resample's median is sought first.
RUNS = 256

_ROWS = 64


def _drawn(placed: DataFrame, coefficients: np.ndarray, runs: int) -> DataFrame:
    """(k, run, w, s, q): of each resample the sums of weights, w x and w x^2 over the values of a run; each task adds up its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for x, _, run, weights in _weighed(batches, coefficients):
            for r in np.unique(run).tolist():
                own, w = x[run == r], weights[run == r]
                held = sums.setdefault(r, np.zeros((3, len(coefficients))))
                held += np.stack([w.sum(axis=0), own @ w, own**2 @ w])
        for r, held in sums.items():
            k = np.arange(len(coefficients))
            yield pa.record_batch([pa.array(k), pa.array(np.full(len(k), r)), *map(pa.array, held)], names=["k", "run", "w", "s", "q"])

    rows = placed.select("x", "n", "before", (F.col("run") if runs > 1 else F.lit(0)).cast("long").alias("run"))
    return rows.mapInArrow(work, "k long, run long, w double, s double, q double").groupBy("k", "run").agg(*[F.sum(c).alias(c) for c in "wsq"])


def _weighed(batches: Iterator[pa.RecordBatch], coefficients: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Some values at a time, with as many rows each: x, before, run, and their weights, a column for each resample."""
    for batch in batches:
        x, n, before, run = (c.to_numpy() for c in batch.columns)
        for many in np.unique(n).tolist():
            same = np.flatnonzero(n == many)
            for at in range(0, len(same), _ROWS):
                rows = same[at : at + _ROWS]
                yield x[rows], before[rows], run[rows], poisson_weights(coefficients, before[rows], many)


def _medians(placed: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """(k, m): the median of each resample. Runs are added up first; values are only looked at in the runs that hold a median."""
    by_run = Window.partitionBy("k").orderBy("run")  # RUNS rows
    runs = _drawn(placed, coefficients, RUNS).select("k", "run", "w", F.sum("w").over(by_run).alias("upto"), F.sum("w").over(Window.partitionBy("k")).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    holds = lambda place: (F.col("upto") - F.col("w") <= place) & (place < F.col("upto"))
    sought = runs.where("total > 0").where(holds(low) | holds(high)).select("k", "run", (F.col("upto") - F.col("w")).alias("below"), "total")
    sought = stored(sought, "sought")
    wanted: dict[int, list[int]] = {}
    for r in sought.select("k", "run").collect():  # two rows for each resample at most
        wanted.setdefault(r["run"], []).append(r["k"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in np.unique(batch.column(3).to_numpy()).tolist():
                ks = np.array(sorted(wanted.get(r, ())), np.int64)
                if not len(ks):
                    continue
                own = batch.filter(pc.equal(batch.column(3), r))
                for x, _, _, weights in _weighed(iter((own,)), coefficients[ks]):
                    i, k = np.nonzero(weights)
                    yield pa.record_batch([pa.array(ks[k]), pa.array(np.full(len(k), r)), pa.array(x[i]), pa.array(weights[i, k])], names=["k", "run", "x", "w"])

    values = placed.select("x", "n", "before", "run").mapInArrow(work, "k long, run long, x double, w long").join(sought, ["k", "run"])
    upto = values.withColumn("upto", F.col("below") + F.sum("w").over(Window.partitionBy("k", "run").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    return upto.groupBy("k").agg(((F.max(F.when(holds(low), F.col("x"))) + F.max(F.when(holds(high), F.col("x")))) / 2).alias("m"))


def bootstrap_ci(returns: DataFrame, column: str = "pnl", n_bootstrap: int = 1000, level: float = 0.95, seed: int = 42, statistic: str = "mean") -> DataFrame:
    """lower, upper, and the statistic of the sample itself under its name: percentile bounds over resamples, one row.

    statistic is mean, median or sharpe (mean by population deviation, times the root of 252). Each resample holds each row as often as a Poisson
    draw with mean 1 says; rows of one value are drawn for at once, so that the cost goes with distinct values, not with rows. Draws depend on the
    value's place among all in order and on the resample's number, and a task adds its values up before anything is
    shuffled. Null values take no part. Without values the bounds are null, the mean is 0 and other statistics are null; so is a Sharpe ratio without deviation.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic: {statistic}")
    spark = returns.sparkSession
    values = returns.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    placed = stored(value_places(values, "x", "n"), "placed")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(1)).cast("long").alias("total"))
    placed = placed.join(F.broadcast(total)).withColumn("run", F.floor(F.col("before") / F.col("total") * RUNS)).drop("total")  # one row
    coefficients = np.array([tuple(r)[1:] for r in resamples(spark, n_bootstrap, seed).orderBy("k").collect()], np.int64).reshape(-1, 4)  # n_bootstrap rows
    if statistic == "median":
        each, whole = _medians(placed, coefficients), exact_quantiles(returns, {statistic: (column, 0.5)})
    else:
        of = _OF_SUMS[statistic]
        each = _drawn(placed, coefficients, 1).where("w > 0").select("k", of(F.col("w"), F.col("s"), F.col("q")).alias("m"))
        n, x = F.col("n"), F.col("x")
        whole = placed.agg(F.sum(n).alias("w"), F.sum(n * x).alias("s"), F.sum(n * x * x).alias("q"))
        whole = whole.select(F.coalesce(of(F.col("w"), F.col("s"), F.col("q")), F.lit(0.0) if statistic == "mean" else F.lit(None).cast("double")).alias(statistic))
    tail = (1 - level) / 2
    bounds = each.agg(F.percentile("m", F.lit(tail)).alias("lower"), F.percentile("m", F.lit(1 - tail)).alias("upper"))  # n_bootstrap rows
    return bounds.join(F.broadcast(whole))  # one row each


def compare(model: DataFrame, baseline: DataFrame, column: str = "pnl", significance: float = 0.05, seed: int = 42) -> dict:
    """t test, Mann-Whitney test, whether bootstrap intervals overlap, and whether the model is better."""
    t, u = t_test(model, baseline, column), mann_whitney(model, baseline, column)
    a, b = (bootstrap_ci(x, column, seed=seed).first() for x in (model, baseline))
    overlap = None if a["lower"] is None or b["lower"] is None else not (a["upper"] < b["lower"] or b["upper"] < a["lower"])
    return {"t_test": t, "mann_whitney": u, "ci_overlap": overlap, "t_test_significant": t["p_value"] < significance, "mann_whitney_significant": u["p_value"] < significance, "model_better": t["difference"] > 0 and t["p_value"] < significance}
