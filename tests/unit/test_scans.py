import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickweave.functions import scans
from tickweave.operators import bars, folds


def test_composed_maps():
    rng = np.random.default_rng(1)
    f, t = rng.normal(size=50), rng.normal(size=50)
    slopes, offsets = scans.composed(f, t)
    x = start = 1.7
    for i in range(50):
        x = f[i] * x + t[i]
        assert np.isclose(x, slopes[i] * start + offsets[i])


def made(spark, n=150):
    rng = random.Random(6)
    rows = [(s, i, *(100 + rng.random() for _ in range(4))) for s, m in (("A", n), ("B", 1), (None, 40)) for i in range(m)]
    return rows, spark.createDataFrame(rows, "symbol string, bar_index long, bid_open double, bid_high double, bid_low double, bid_close double").repartition(4)


@pytest.mark.parametrize("size", [3, 64, None])
def test_heikin_ashi_against_a_loop(spark, size):
    rows, df = made(spark)
    expected, last = {}, {}
    for s, i, o, h, low, c in rows:
        close = (o + h + low + c) / 4
        opened = sum(last[s]) / 2 if s in last else (o + c) / 2
        last[s] = (opened, close)
        expected[s, i] = (opened, max(h, opened, close), min(low, opened, close), close)
    got = bars.heikin_ashi(df, size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose([r.ha_open, r.ha_high, r.ha_low, r.ha_close], expected[r.symbol, r.bar_index], atol=1e-12)


def test_recursions_of_other_factors(spark):
    df = spark.range(40).select(F.lit("S").alias("symbol"), (3 * F.col("id")).alias("at"), F.col("id").alias("v"))
    got = [r.x for r in scans.affine_scan(df, "at", F.lit(-0.9), F.when(F.col("v") != 30, F.col("v")), "x", size=10).orderBy("at").collect()]
    x = 0.0
    for i in range(30):
        x = -0.9 * x + i
        assert np.isclose(got[i], x)
    assert got[30:] == [None] * 10
    assert scans.affine_scan(df.limit(0), "at", F.lit(1.0), F.lit(1.0), "x").count() == 0


def test_sampled_combinations_are_made_without_listing_all():
    from itertools import combinations

    every = list(combinations(range(9), 4))
    assert [folds.combination_at(i, 9, 4) for i in range(len(every))] == every
    assert folds.cpcv_combinations(9, 4) == every
    assert folds.cpcv_combinations(9, 4, 5, seed=3) == [every[i] for i in sorted(random.Random(3).sample(range(len(every)), 5))]
    start = time.time()
    got = folds.cpcv_combinations(40, 20, 10)
    assert time.time() - start < 1 and len(set(got)) == 10 and got == sorted(got) and all(len(set(c)) == 20 and max(c) < 40 for c in got)
    assert len(folds.cpcv_combinations(120, 60, 7)) == 7
