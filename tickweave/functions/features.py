"""Features of bars: each function adds columns over a Frame. Null is undefined (warm-up rows, missing input)."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import Frame, in_blocks


def mid() -> Column:
    return (F.col("bid_close") + F.col("ask_close")) / 2


def log_returns(bars: DataFrame, f: Frame, lookbacks: Iterable[int], price: str = "bid_close") -> DataFrame:
    return bars.withColumns({f"ret_{n}": F.ln(F.try_divide(F.col(price), f.lag(price, n))) for n in lookbacks})


def volatility(bars: DataFrame, f: Frame, lookbacks: Iterable[int], price: str = "bid_close") -> DataFrame:
    one = bars.withColumn("_r1", F.ln(F.try_divide(F.col(price), f.lag(price, 1))))
    return one.withColumns({f"vol_{n}": f.gate(F.stddev_samp, "_r1", n) for n in lookbacks}).drop("_r1")


def bar_ranges(bars: DataFrame, f: Frame, lookbacks: Iterable[int], high: str = "bid_high", low: str = "bid_low") -> DataFrame:
    ranged = bars.withColumn("range", F.col(high) - F.col(low))
    return ranged.withColumns({f"avg_range_{n}": f.gate(F.avg, "range", n) for n in lookbacks})


def spread_features(bars: DataFrame, f: Frame, lookbacks: Iterable[int]) -> DataFrame:
    source = next((c for c in ("spread_mean", "spread") if c in bars.columns), None)
    level = bars.withColumn("spread", F.col(source) if source else F.col("ask_close") - F.col("bid_close"))
    rolled = {f"spread_{k}_{n}": f.gate(a, "spread", n) for n in lookbacks for k, a in (("mean", F.avg), ("std", F.stddev_samp))}
    return level.withColumns({"spread_change": F.col("spread") - f.lag("spread"), **rolled})


def tick_direction(bars: DataFrame, f: Frame, price: str = "bid_close") -> DataFrame:
    """Sign of the change of price; 0 at the first bar."""
    return bars.withColumn("tick_direction", F.coalesce(F.signum(F.col(price) - f.lag(price)), F.lit(0.0)))


def order_flow(bars: DataFrame, f: Frame, lookbacks: Iterable[int], price: str = "bid_close") -> DataFrame:
    return tick_direction(bars, f, price).withColumns({f"of_imbalance_{n}": f.gate(F.avg, "tick_direction", n) for n in lookbacks})


def volume_imbalance(bars: DataFrame, f: Frame, lookbacks: Iterable[int]) -> DataFrame:
    total = F.col("bidVolume_sum") + F.col("askVolume_sum")
    one = bars.withColumn("volume_imbalance", F.when(total > 0, (F.col("bidVolume_sum") - F.col("askVolume_sum")) / total).otherwise(0.0))
    return one.withColumns({f"vol_imbalance_{n}": f.gate(F.avg, "volume_imbalance", n) for n in lookbacks})


def microstructure(bars: DataFrame, f: Frame, spreads: Iterable[int], flows: Iterable[int]) -> DataFrame:
    out = order_flow(spread_features(bars, f, spreads), f, flows)
    return volume_imbalance(out, f, flows) if {"bidVolume_sum", "askVolume_sum"} <= set(bars.columns) else out


def bar_stats(bars: DataFrame, f: Frame, period: int = 20, include_tick_count: bool = True, include_volume: bool = True) -> DataFrame:
    new = {}
    if include_tick_count and "tick_count" in bars.columns:
        new["tick_count_norm"] = F.try_divide(F.col("tick_count").cast("double"), f.gate(F.avg, "tick_count", period))
    if "bar_duration_sec" in bars.columns:
        new["bar_duration"] = F.col("bar_duration_sec")
    if include_volume and "bidVolume_sum" in bars.columns:
        new["volume"] = F.col("bidVolume_sum") + (F.col("askVolume_sum") if "askVolume_sum" in bars.columns else 0)
    return bars.withColumns(new)


def ma_slopes(bars: DataFrame, f: Frame, periods: Iterable[int] = (5, 10, 20, 50), price: Column | None = None) -> DataFrame:
    periods = tuple(periods)
    one = bars.withColumn("_p", mid() if price is None else price).withColumns({"_change": F.try_divide(F.col("_p"), f.lag(mid() if price is None else price)) - 1})
    two = one.withColumns({f"ma_{n}": f.gate(F.avg, "_p", n) for n in periods} | {f"_vol_{n}": f.gate(F.stddev_samp, "_change", n) for n in periods})
    three = two.withColumns({f"ma_{n}_slope": (F.col(f"ma_{n}") - f.lag(f"ma_{n}", n)) / n for n in periods} | {f"dist_to_ma_{n}": F.try_divide(F.col("_p") - F.col(f"ma_{n}"), F.col(f"ma_{n}")) for n in periods})
    norm = {f"ma_{n}_slope_norm": F.try_divide(F.col(f"ma_{n}_slope"), F.col("_p") * F.nullif(F.col(f"_vol_{n}"), F.lit(0.0))) for n in periods}
    return three.withColumns(norm).drop("_p", "_change", *[f"_vol_{n}" for n in periods])


#: Fast and slow periods of the crossovers.
CROSSES = ((5, 10), (10, 20), (20, 50))


def ma_cross(bars: DataFrame, f: Frame, price: Column | None = None) -> DataFrame:
    """1 where the fast average is above the slow one, else -1 (in the warm-up too), and the distance."""
    periods = sorted({n for pair in CROSSES for n in pair})
    one = bars.withColumn("_p", mid() if price is None else price)
    two = one.withColumns({f"_ma{n}": f.gate(F.avg, "_p", n) for n in periods})
    new = {}
    for a, b in CROSSES:
        new[f"ma_cross_{a}_{b}"] = F.when(F.col(f"_ma{a}") > F.col(f"_ma{b}"), 1).otherwise(-1)
        new[f"ma_cross_{a}_{b}_strength"] = F.try_divide(F.col(f"_ma{a}") - F.col(f"_ma{b}"), F.col(f"_ma{b}"))
    return two.withColumns(new).drop("_p", *[f"_ma{n}" for n in periods])


def trend_regression(bars: DataFrame, f: Frame, window: int = 50, price: str = "bid_close") -> DataFrame:
    """Slope and R² of the last `window` prices on their places; defined from row `window` on."""
    ready = F.col("bar_index") >= window
    over = f.roll(window)
    x = F.col("bar_index").cast("double")
    return bars.withColumns({"trend_slope": F.when(ready, F.regr_slope(F.col(price), x).over(over)), "trend_strength": F.when(ready, F.regr_r2(F.col(price), x).over(over))})


def macro_features(bars: DataFrame, f: Frame, long: int = 50, price: str = "bid_close") -> DataFrame:
    one = bars.withColumn("ret_long", F.ln(F.try_divide(F.col(price), f.lag(price, long))))
    return trend_regression(one.withColumn("vol_long", f.gate(F.stddev_samp, "ret_long", long)), f, long, price)


def micro_features(bars: DataFrame, f: Frame) -> DataFrame:
    one = volume_imbalance(tick_direction(spread_features(bars, f, ()), f), f, ())
    return one.withColumnRenamed("volume_imbalance", "of_imbalance")


def frac_diff_weights(d: float, size: int, threshold: float, inclusive: bool = False) -> list[float]:
    """Weights of the binomial series of (1 - B)^d, cut where they fall to the threshold (that one included, if asked for)."""
    if not 0 < d < 1:
        raise ValueError(f"d must lie between 0 and 1, not {d}")
    out = [1.0]
    while len(out) < size:
        after = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(after) <= threshold:
            return [*out, after] if inclusive else out
        out.append(after)
    return out


def frac_diff(bars: DataFrame, f: Frame, column: str, d: float, threshold: float, fixed_width: bool = False, include_current: bool = False, size: int = 100_000) -> DataFrame:
    """`column`_fracdiff: weighted sum of the values before each row, the latest first; null until there are enough."""
    weights = np.array(frac_diff_weights(d, size, threshold, inclusive=fixed_width))
    n, lag = len(weights), 0 if include_current else 1

    def convolve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in f.order])
        x = rows.column(column).cast(pa.float64()).to_numpy()
        out = np.full(len(x), np.nan)
        if len(x) >= n + lag:
            out[n - 1 + lag :] = np.convolve(x, weights, "valid")[: len(x) - n + 1 - lag]
        return rows.append_column(f"{column}_fracdiff", pa.array(out, from_pandas=True))

    schema = T.StructType([*bars.schema.fields, T.StructField(f"{column}_fracdiff", T.DoubleType())])
    return bars.groupBy(*f.keys).applyInArrow(convolve, schema)


def frac_diff_columns(bars: DataFrame, f: Frame, config: dict) -> DataFrame:
    """`column`_fracdiff by fixed-width windows for each column of config that there is, if config is enabled; a missing one warns."""
    if not config.get("enabled", False):
        return bars
    if missing := [k for k in ("d", "columns") if k not in config]:
        raise ValueError(f"fractional differences lack {', '.join(missing)}")
    for column in config["columns"]:
        if column in bars.columns:
            bars = frac_diff(bars, f, column, config["d"], config.get("threshold", 1e-2), fixed_width=True)
        else:
            warnings.warn(f"no column {column} to difference", stacklevel=2)
    return bars


def rsi(bars: DataFrame, f: Frame, period: int = 14, price: str = "bid_close") -> DataFrame:
    """Relative strength from plain means of gains and losses; the first change counts as none."""
    change = F.coalesce(F.col(price) - f.lag(price), F.lit(0.0))
    one = bars.withColumn("_d", change)
    two = one.withColumns({"_gain": F.greatest("_d", F.lit(0.0)), "_loss": F.greatest(-F.col("_d"), F.lit(0.0))})
    ratio = f.gate(F.avg, "_gain", period) / (f.gate(F.avg, "_loss", period) + 1e-10)
    return two.withColumn("rsi", 100 - 100 / (1 + ratio)).drop("_d", "_gain", "_loss")


def feature_matrix(bars: DataFrame, returns: Iterable[int] = (1, 5, 10), vols: Iterable[int] = (10, 20), spreads: Iterable[int] = (5, 10), flows: Iterable[int] = (5, 10), periods: Iterable[int] = (5, 10, 20, 50)) -> DataFrame:
    """All features of a bar on its row, bars' own columns included: one exchange by (symbol, block), no join."""
    periods = tuple(periods)
    steps = [
        lambda d, f: log_returns(d, f, returns),
        lambda d, f: volatility(d, f, vols),
        lambda d, f: microstructure(d, f, spreads, flows),
        lambda d, f: bar_stats(d, f),
        lambda d, f: ma_slopes(d, f, periods),
        ma_cross,
    ]
    reach = max([*returns, *(n + 1 for n in vols), *(n + 1 for n in spreads), *(n + 1 for n in flows), 20, 2 * max(periods), 50])
    return in_blocks(bars, lambda d, f: reduce(lambda x, step: step(x, f), steps, d), reach)
