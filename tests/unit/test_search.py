import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tickweave.functions import chains, search, windows
from tickweave.operators import bars, folds, validate

from .test_bars import START


def path(n, seed):
    rng = random.Random(seed)
    out, close = [], 100.0
    for i in range(n):
        close += rng.choice([-1, -0.5, 0, 0.5, 1])
        out.append((rng.choice(["A", "B"]) if seed % 2 else "A", i, START + dt.timedelta(seconds=i), close + rng.choice([0, 0.5]) if rng.random() > 0.1 else None, close - 0.5, close, rng.random() < 0.05, rng.choice([None, 0, 1, 4, 9])))
    seen = {}
    rows = []
    for s, _, *rest in out:
        seen[s] = seen.get(s, -1) + 1
        rows.append((s, seen[s], *rest))
    return rows


def brute(rows, longest):
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == s)
        for i, r in enumerate(own):
            after = own[i + 1 : i + 1 + min(r[7] or 0, longest)]
            for x in after:
                kind = search.HALT if x[6] else search.UP if x[3] is not None and x[3] >= r[5] + 1 else search.DOWN if x[4] <= r[5] - 1 else search.NONE
                if kind:
                    break
            if after:
                out[s, i] = (x[1], x[2], x[5], kind)
    return out


@pytest.mark.parametrize("seed,block", [(1, 65_536), (2, 65_536), (3, 7), (4, 20)])
def test_first_reach_matches_a_loop(spark, monkeypatch, seed, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    rows = path(300, seed)
    df = spark.createDataFrame(rows, "symbol string, bar_index long, timestamp timestamp, bid_high double, bid_low double, bid_close double, halt boolean, ahead int").repartition(3)
    found = search.first_reach(df, F.col("bid_close") + 1, F.col("bid_close") - 1, F.col("ahead"), 6, F.col("halt"), keep=("ahead",))
    got = {(r.symbol, r.bar_index): (r.exit_bar, r.exit_timestamp, r.exit_close, r.outcome) for r in found.collect()}
    assert got == brute(rows, 6) and {g[3] for g in got.values()} == {0, 1, 2, 3}
    assert search.first_reach(df.limit(0), F.col("bid_close"), F.col("bid_close"), F.col("ahead"), 6).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 1.0, 7.7, 1e9])
def test_reset_bars_equal_a_loop_over_ticks(threshold):
    """Sums of tenths, where rounding decides whether a threshold is met."""
    amounts = np.random.default_rng(3).choice([0.1, 0.2, 0.7, 0.0, np.nan, 2.5], 3000)
    want, bar, held = [], 0, 0.0
    for x in amounts.tolist():
        want.append(bar)
        held += 0.0 if x != x else x
        if held >= threshold:
            bar, held = bar + 1, 0.0
    steps = bars._reset_steps(threshold)(pa.table({"_amount": amounts}))
    taken = np.isin(np.arange(3000), chains.taken_rows(steps, threshold))
    assert (np.cumsum(taken) - taken).tolist() == want


def test_temporal_safety_across_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(s, i, START + dt.timedelta(seconds=rng.randrange(60))) for s in ("A", "B", None) for i in rng.sample(range(-50, 400), 80)]
    df = spark.createDataFrame(rows, "symbol string, seq long, timestamp timestamp").repartition(3)
    want = {}
    for s in ("A", "B", None):
        own = [r[2] for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1])]
        want[s] = (len(own), len(own) - len(set(own)), sum(a > b for a, b in zip(own, own[1:])))
    for size in (1 << 16, 9):
        monkeypatch.setattr(validate, "SEQ_BLOCK", size)
        assert {r.symbol: (r.n_rows, r.n_repeated, r.n_backward) for r in validate.temporal_safety(df).collect()} == want


def test_folds_of_several_symbols(spark):
    rows = [(s, i, START + dt.timedelta(seconds=i // 2)) for s in ("B", "A") for i in range(20)]
    df = folds.numbered(spark.createDataFrame(rows, "symbol string, bar_index long, timestamp timestamp"))
    order = [(r.symbol, r.bar_index) for r in df.orderBy("row_idx").collect()]
    assert order == [(s, i) for _, s, i in sorted((r[2], r[0], r[1]) for r in rows)] and [r.row_idx for r in df.orderBy("row_idx").collect()] == list(range(40))
    tests = folds.time_series_folds(df, 3).where("role = 'test'").groupBy("fold_id").count().collect()
    assert sorted((r.fold_id, r["count"]) for r in tests) == [(0, 10), (1, 10), (2, 10)]
    timed = df.select("row_idx", F.unix_micros("timestamp").alias("start_idx"), F.unix_micros("timestamp").alias("end_idx"))
    joined = df.join(folds.cpcv_folds(timed, 4, 1), "row_idx").groupBy("fold_id").count().collect()
    assert all(r["count"] <= 40 for r in joined) and len(joined) == 4
