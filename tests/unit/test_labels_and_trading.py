import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickweave.operators import backtest, bars, folds, joins, labeling, performance, signals
from tickweave.operators.session import SessionCalendar

from .test_bars import START, ticks

BAR = "symbol string, bar_index long, timestamp timestamp, bid_high double, bid_low double, bid_close double, ask_close double"


def made(spark, highs, lows, closes, start=START, seconds=60):
    rows = [("A", i, start + dt.timedelta(seconds=seconds * i), float(h), float(lo), float(c), c + 0.25) for i, (h, lo, c) in enumerate(zip(highs, lows, closes))]
    return spark.createDataFrame(rows, BAR)


@pytest.mark.parametrize(
    "highs,lows,label,exit_bar",
    [([10, 10, 12, 9], [10, 10, 10, 5], 1, 2), ([10, 10, 10, 12], [10, 8, 10, 10], -1, 1), ([10, 12, 10, 10], [10, 8, 10, 10], 1, 1), ([10, 10, 10, 10], [10, 10, 10, 10], 0, 3)],
)
def test_first_barrier_decides_and_the_upper_one_wins_a_tie(spark, highs, lows, label, exit_bar):
    got = labeling.triple_barrier(made(spark, highs, lows, [10, 10, 10, 10]), 2, 2, 3, 1).where("bar_index_start = 0").first()
    assert (got.label, got.bar_index_end, got.entry_price, got.pnl) == (label, exit_bar, 10.25, -0.25)


def test_no_label_without_room_or_future(spark):
    late = made(spark, [10] * 6, [10] * 6, [10] * 6, start=START.replace(hour=21, minute=52))
    got = labeling.triple_barrier(late, 1, 1, 5, 2).select("bar_index_start", "effective_horizon").collect()
    assert [(r.bar_index_start, r.effective_horizon) for r in sorted(got)] == [(0, 3), (1, 2)]  # six bars span 300 s, so one counts as 50 s
    assert labeling.triple_barrier(late.limit(0), 1, 1, 5, 2).count() == 0
    assert labeling.meta_labels(labeling.triple_barrier(late, 1, 1, 5, 2)).where("meta_label = 1").count() == 0


def test_barriers_match_a_loop_in_blocks_too(spark, monkeypatch):
    df, _ = ticks(spark, 900, 9)
    b = bars.build_bars(df, bars.BarSpec("tick", 3)).cache()
    rows = b.orderBy("bar_index").collect()
    seconds = (rows[-1].timestamp - rows[0].timestamp).total_seconds() / len(rows)
    want = {}
    for i, r in enumerate(rows):
        left = max(0.0, (r.timestamp.replace(hour=21, minute=55, second=0, microsecond=0) - r.timestamp).total_seconds())
        h = min(12, int(left // seconds))
        after = rows[i + 1 : i + 1 + h]
        if h < 2 or not after:
            continue
        hit = next((x for x in after if x.bid_high >= r.bid_close + 0.3 or x.bid_low <= r.bid_close - 0.3), None)
        want[i] = (0 if hit is None else 1 if hit.bid_high >= r.bid_close + 0.3 else -1, (hit or after[-1]).bar_index)
    from tickweave.functions import windows

    for size in (65_536, 50):
        monkeypatch.setattr(windows, "BLOCK", size)
        assert {r.bar_index_start: (r.label, r.bar_index_end) for r in labeling.triple_barrier(b, 0.3, 0.3, 12, 2).collect()} == want
    ex = {r.bar_index: (r.mfe, r.mae) for r in labeling.excursions(b, 6).collect()}
    for i, r in enumerate(rows):
        after = rows[i + 1 : i + 7]
        assert ex[i] == ((max(x.bid_high for x in after) - r.ask_close, r.ask_close - min(x.bid_low for x in after)) if len(after) == 6 else (None, None))


def test_sessions(spark):
    cal = SessionCalendar()
    times = {"sat": "2024-01-06 12:00:00", "late": "2024-01-08 22:00:00", "fri": "2024-01-05 20:00:00", "fri_in": "2024-01-05 19:00:00"}
    df = spark.createDataFrame(list(times.items()), "name string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.name: r for r in df.select("name", cal.is_weekend("t").alias("weekend"), cal.trading_allowed("t").alias("open"), cal.time_to_end("t", "hours").alias("left"), cal.near_end("t").alias("near")).collect()}
    assert got["sat"].weekend and not got["sat"].open and not got["late"].open and got["late"].left == 0
    assert got["fri"].open and got["fri"].left == 0 and got["fri"].near and got["fri_in"].left == 1.0 and not got["fri_in"].near
    with pytest.raises(ValueError):
        cal.time_to_end("t", "days")
    ny = SessionCalendar("America/New_York", "09:30", "16:00", "16:00")
    at = df.select(ny.session_end("t").alias("e")).collect()
    assert at[2].e == dt.datetime(2024, 1, 5, 21, 0)


def brute_cpcv(starts, ends, n_groups, k, embargo):
    from itertools import combinations

    n = len(starts)
    groups = [g for g, part in enumerate(np.array_split(np.arange(n), n_groups)) for _ in part]
    out = set()
    for fold, chosen in enumerate(combinations(range(n_groups), k)):
        test = [i for i in range(n) if groups[i] in chosen]
        banned = {i + e for i in test if i + 1 not in test for e in range(1, embargo + 1)}
        low, high = min(starts[i] for i in test), max(ends[i] for i in test)
        train = [i for i in range(n) if i not in test and i not in banned and not (ends[i] >= low and starts[i] <= high)]
        if train:
            out |= {(fold, i, "test") for i in test} | {(fold, i, "train") for i in train}
    return out


def test_purged_folds_match_a_loop(spark):
    rng = random.Random(1)
    starts = list(range(103))
    ends = [i + rng.randrange(9) for i in starts]
    df = spark.createDataFrame(list(zip(range(103), starts, ends)), "row_idx long, start_idx long, end_idx long")
    got = {tuple(r) for r in folds.cpcv_folds(df, 5, 2, 4).select("fold_id", "row_idx", "role").collect()}
    assert got == brute_cpcv(starts, ends, 5, 2, 4)
    assert folds.n_combinations(10, 2) == 45 and len(folds.cpcv_combinations(10, 2, 7)) == 7
    per_run = {tuple(r) for r in folds.cpcv_folds(df, 5, 2, 4, purge="per_run").select("fold_id", "row_idx", "role").collect()}
    assert got <= per_run and len({f for f, *_ in per_run}) == 10


def test_time_series_folds_train_on_the_past(spark):
    df = spark.range(53).withColumnRenamed("id", "row_idx")
    rows = folds.time_series_folds(df, 4, gap=3).toPandas()
    for _, part in rows.groupby("fold_id"):
        assert part[part.role == "train"].row_idx.max() + 3 < part[part.role == "test"].row_idx.min() and (part.role == "test").sum() == 10
    with pytest.raises(ValueError):
        folds.time_series_folds(df, 60)


def test_asof_matches_a_search(spark):
    rng = random.Random(4)
    right = sorted(rng.sample(range(400_000), 40))
    left = [rng.randrange(-5000, 405_000) for _ in range(150)] + right[:5]
    at = lambda s: START + dt.timedelta(seconds=s)
    r = spark.createDataFrame([("A", at(s), s) for s in right], "symbol string, timestamp timestamp, v long")
    lf = spark.createDataFrame([("A", at(s), i) for i, s in enumerate(left)], "symbol string, timestamp timestamp, i long")
    best = lambda s: min(right, key=lambda x: (abs(x - s), -x))
    assert {x.i: x.v for x in joins.asof(lf, r, ["v"]).collect()} == {i: best(s) for i, s in enumerate(left)}
    assert {x.i: x.v for x in joins.asof(lf, r, ["v"], "backward").collect()} == {i: max((x for x in right if x <= s), default=None) for i, s in enumerate(left)}
    assert {x.i: x.v for x in joins.asof(lf, r, ["v"], "forward").collect()} == {i: min((x for x in right if x >= s), default=None) for i, s in enumerate(left)}


def test_backtest_holds_one_position_and_none_past_the_session(spark):
    df, _ = ticks(spark, 4000, 12)
    b = bars.build_bars(df, bars.BarSpec("tick", 4)).cache()
    spec = backtest.BacktestSpec(0.5, 0.5, max_bars=30)
    log = backtest.run_backtest(b, signals.buy_and_hold(b), spec).orderBy("entry_bar").collect()
    assert len(log) > 20
    for x, y in zip(log, log[1:]):
        assert y.entry_bar > x.exit_bar
    for x in log:
        assert 0 < x.exit_bar - x.entry_bar <= 30 and x.pnl == x.exit_price - x.entry_price
        end = x.entry_timestamp.replace(hour=20 if x.entry_timestamp.weekday() == 4 else 21, minute=0 if x.entry_timestamp.weekday() == 4 else 55, second=0)
        assert (end - x.entry_timestamp).total_seconds() > 600 and x.entry_timestamp.weekday() < 5
    equity = backtest.equity_curve(spark.createDataFrame(log), 100.0).orderBy("exit_timestamp", "entry_bar").toPandas().equity.to_numpy()
    assert np.allclose(equity, 100 + np.cumsum([x.pnl for x in log]))
    m = performance.basic(spark.createDataFrame(log), 100.0).first()
    peak = np.maximum.accumulate(equity)
    assert np.isclose(m.max_drawdown, ((equity - peak) / peak).min()) and m.n_trades == len(log)
    for bad in ({"tp": 0, "sl": 1}, {"tp": 1, "sl": 1, "barrier_ref": "mid"}):
        with pytest.raises(ValueError):
            backtest.BacktestSpec(**bad)
    assert {r.prediction for r in signals.random_signals(b, long_only=False).collect()} == {-1, 0, 1}


def test_ratios_at_their_edges(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "pnl double")
    one = df.agg(performance.profit_factor().alias("pf"), performance.sortino("pnl").alias("s"), performance.sharpe("pnl").alias("sh"), performance.win_rate().alias("w")).first()
    assert one.pf == float("inf") and one.s == float("inf") and one.w == 1.0 and np.isclose(one.sh, 1.5 / 0.5 * 252**0.5)
    none = df.limit(0).agg(performance.profit_factor().alias("pf"), performance.sortino("pnl").alias("s"), performance.sharpe("pnl").alias("sh"), performance.expectancy().alias("e")).first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0)


def test_bars_left_over_weekends_and_gaps(spark):
    """Counted one by one, of a symbol that trades on Friday, the weekend and Monday, with a gap and a bar at the very end."""
    import datetime as dt

    rng, cal = random.Random(8), SessionCalendar(end="20:00", friday_end="18:00")
    times = sorted({dt.datetime(2024, 1, 5, 12) + dt.timedelta(minutes=rng.randrange(5000)) for _ in range(120)} | {dt.datetime(2024, 1, 5, 18), dt.datetime(2024, 1, 8, 20)})
    rows = [("A", i, t) for i, t in enumerate(times)] + [("B", 0, times[5])]
    df = spark.createDataFrame(rows, "symbol string, bar_index long, timestamp timestamp").repartition(3)
    for weekend in (False, True):
        cal = SessionCalendar(end="20:00", friday_end="18:00", weekend_trading=weekend)
        got = {(r.symbol, r.bar_index): r.bars_left for r in labeling.with_bars_left(df, cal).collect()}
        for s, i, t in rows:
            end = t.replace(hour=18 if t.weekday() == 4 else 20, minute=0, second=0)
            closed = t.weekday() >= 5 and not weekend
            assert got[s, i] == (0 if closed else sum(o == s and j > i and u <= end for o, j, u in rows))
    with pytest.raises(ValueError):
        labeling.triple_barrier(df, 1.0, 1.0, 5, 1, session="roughly")
