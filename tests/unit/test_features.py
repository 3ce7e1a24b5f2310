
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from tickweave.functions import features as ft
from tickweave.functions.windows import Frame, in_blocks
from tickweave.operators import bars, validate

from .test_bars import ticks


@pytest.fixture(scope="module")
def made(spark):
    df, _ = ticks(spark, 900, 7)
    return bars.build_bars(df, bars.BarSpec("tick", 5)).cache()


@pytest.fixture(scope="module")
def frame(made):
    return made.orderBy("bar_index").toPandas()


def same(got, want):
    a, b = np.array(got, float), np.array(want, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=1e-9, atol=1e-12)


def test_features_match_pandas(made, frame):
    got = ft.feature_matrix(made).orderBy("bar_index").toPandas()
    p, mid = frame.bid_close, (frame.bid_close + frame.ask_close) / 2
    r1 = np.log(p / p.shift(1))
    same(got.ret_5, np.log(p / p.shift(5)))
    same(got.vol_20, r1.rolling(20).std())
    same(got.spread_std_10, frame.spread_mean.rolling(10).std())
    same(got.of_imbalance_5, np.sign(p.diff()).fillna(0).rolling(5).mean())
    ma = mid.rolling(20).mean()
    same(got.ma_20_slope, (ma - ma.shift(20)) / 20)
    same(got.ma_20_slope_norm, (ma - ma.shift(20)) / 20 / (mid * mid.pct_change().rolling(20).std().replace(0, np.nan)))
    same(got.ma_cross_5_10, np.where(mid.rolling(5).mean() > mid.rolling(10).mean(), 1, -1))


def test_regression_and_fractional_differences_match_numpy(made, frame):
    p = frame.bid_close.to_numpy()
    got = in_blocks(made, lambda d, f: ft.trend_regression(d, f, 30), 30).orderBy("bar_index").toPandas()
    want = np.full(len(p), np.nan)
    for i in range(30, len(p)):
        want[i] = np.polyfit(np.arange(30), p[i - 29 : i + 1], 1)[0]
    same(got.trend_slope, want)
    weights = ft.frac_diff_weights(0.4, 1000, 1e-2)
    fd = in_blocks(made, lambda d, f: ft.frac_diff(d, f, "bid_close", 0.4, 1e-2), 60).orderBy("bar_index").toPandas()
    want = np.full(len(p), np.nan)
    for i in range(len(weights), len(p)):
        want[i] = np.dot(weights, p[i - len(weights) : i][::-1])
    same(fd.bid_close_fracdiff, want)
    with pytest.raises(ValueError):
        ft.frac_diff_weights(1.0, 5, 0.1)


@pytest.mark.parametrize("size", [64, 101])
def test_blocks_give_what_one_window_gives(made, size):
    make = lambda d, f: ft.rsi(ft.ma_slopes(ft.volatility(d, f, (20,)), f, (5, 10)), f)
    whole = make(made, Frame()).orderBy("bar_index").toPandas()
    cut = in_blocks(made, make, 21, size=size).orderBy("bar_index").toPandas()
    for c in ("vol_20", "ma_10_slope", "rsi"):
        same(cut[c], whole[c])


def test_features_never_look_ahead(made):
    whole = ft.feature_matrix(made).where("bar_index < 120").orderBy("bar_index").toPandas()
    cut = ft.feature_matrix(made.where("bar_index < 120")).orderBy("bar_index").toPandas()
    pd.testing.assert_frame_equal(whole, cut)
    assert validate.looks_ahead(ft.feature_matrix(made)) == []


def test_what_looks_ahead_is_found(made):
    F, f = ft.F, Frame()
    x, w = F.col("bid_close"), f.ordered
    lags = [F.lag(x, n).over(w).alias(f"lag_{n}") for n in range(1, 40)]
    ahead = {
        "lead": F.lead(x).over(w),
        "rows": F.max(x).over(f.rows(1, 5)),
        "range": F.avg(x).over(w.rangeBetween(0, 5)),
        "back": F.lag(x, -2).over(w),
        "end": F.nth_value(x, 2).over(f.rows(Window.unboundedPreceding, Window.unboundedFollowing)),
        "all": F.sum(x).over(Window.partitionBy("symbol")),
        "reversed": F.lag(x).over(Window.partitionBy("symbol").orderBy(F.desc("bar_index"))),
        "share": F.percent_rank().over(w),
        "time": F.expr("sum(bid_close) over (partition by symbol order by timestamp range between current row and interval 5 seconds following)"),
    }
    for name, column in ahead.items():
        assert [t.split(":")[0] for t in validate.looks_ahead(made.select(*lags, column.alias(name)))] == [name]
        nested = made.withColumn("t", x + column).select(*lags, "t", F.avg("t").over(f.roll(3)).alias("smooth"))
        assert len(validate.looks_ahead(nested)) == 1
    fine = [x + n + F.avg(x).over(f.rows(-n, 0)) for n in range(100)] + [F.sum(x).over(w), F.row_number().over(w), F.rank().over(w), F.avg(x).over(w.rangeBetween(-5, 0)), F.expr("sum(bid_close) over (partition by symbol order by timestamp range between interval 5 seconds preceding and current row)")]
    assert validate.looks_ahead(made.select(*lags, *[c.alias(f"c{i}") for i, c in enumerate(fine)])) == []
    planted = ft.feature_matrix(made.withColumn("bid_close", F.coalesce(F.lead(x).over(w), x)))
    assert len(validate.looks_ahead(planted)) == 1
    made.createOrReplaceTempView("made_bars")
    below = made.sparkSession.sql("select * from made_bars where bid_close > (select avg(n) from (select lead(bid_close) over (partition by symbol order by bar_index) as n from made_bars))")
    assert [t.split(":")[0] for t in validate.looks_ahead(below)] == ["n"]


def test_feature_report(spark):
    rows = [(float(i), 1.0, None if i % 4 == 0 else 1.0 * i, float("inf") if i == 3 else 0.5 * i) for i in range(40)]
    got = {r["column"]: r for r in validate.feature_report(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd")).collect()}
    assert got["a"].is_valid and not got["a"].is_constant and got["b"].is_constant
    assert got["c"].n_null == 10 and not got["c"].is_valid and got["d"].n_inf == 1 and not got["d"].is_valid
