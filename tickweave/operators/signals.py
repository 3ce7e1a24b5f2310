"""Baseline strategies. A strategy is any callable from bars to (symbol, bar_index, timestamp, prediction, probability, meta_decision)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions.draws import draw
from ..functions.windows import in_blocks

Strategy = Callable[[DataFrame], DataFrame]


def _signals(bars: DataFrame, prediction: Column, probability: Column | None = None) -> DataFrame:
    p = prediction.cast("int")
    return bars.select("symbol", "bar_index", "timestamp", p.alias("prediction"), (F.lit(1.0) if probability is None else probability).alias("probability"), F.lit(1).alias("meta_decision"))


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return _signals(bars, F.lit(1))


def random_signals(bars: DataFrame, seed: int = 42, long_only: bool = True) -> DataFrame:
    """Draws that depend on the bar and the seed alone, not on partitions."""
    drawn = draw("symbol", "bar_index", seed) % (2 if long_only else 3)
    return _signals(bars, drawn if long_only else drawn - 1, F.lit(0.5))


def ma_crossover(bars: DataFrame, short: int = 10, long: int = 50, price: str = "bid_close") -> DataFrame:
    made = in_blocks(bars, lambda d, f: d.withColumn("_up", f.gate(F.avg, price, short) > f.gate(F.avg, price, long)), long)
    return _signals(made, F.coalesce("_up", F.lit(False)))


def rsi_signals(bars: DataFrame, period: int = 14, oversold: float = 30.0, price: str = "bid_close") -> DataFrame:
    made = in_blocks(bars, lambda d, f: ft.rsi(d, f, period, price), period + 1)
    return _signals(made, F.coalesce(F.col("rsi") < oversold, F.lit(False)))
