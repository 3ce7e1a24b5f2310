"""Bars from ticks: tick, volume, dollar and cumulative volume bars, in one aggregate each."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chains import Steps, along_chain
from ..functions.prefix import with_prefix
from ..functions.scans import affine_scan
from ..functions.windows import spread_blocks

KINDS = ("tick", "volume", "dollar", "volume_cum")


@dataclass(frozen=True)
class BarSpec:
    """kind: one of KINDS. time: a bar bears its first or its last tick's timestamp. ddof: of spread_std, 1 or 0.

    detail adds the first, last and mean mid price and the least and largest spread.
    """

    kind: str
    threshold: float
    keep_partial: bool = False
    ddof: int = 1
    time: str = "first"
    duration: bool = False
    mid: bool = False
    detail: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of bar: {self.kind}")
        if not self.threshold or self.threshold <= 0:
            raise ValueError("a bar needs a positive threshold")

    @staticmethod
    def parse(text: str, threshold: float | None = None) -> BarSpec:
        """`tick100`, or `volume_bar` with a threshold."""
        if m := re.fullmatch(r"tick(\d+)", text):
            return BarSpec("tick", int(m[1]), keep_partial=True, time="last", duration=True, detail=True)
        if text == "volume_bar" and threshold:
            return BarSpec("volume_cum", threshold, time="last", duration=True, detail=True)
        raise ValueError(f"unknown bars: {text}")

    @staticmethod
    def from_config(config: dict) -> BarSpec:
        missing = [k for k in ("type", "threshold") if k not in config]
        if missing:
            raise ValueError(f"bars lack {', '.join(missing)}")
        return BarSpec(config["type"], config["threshold"])


def aggregate(indexed: DataFrame, spec: BarSpec) -> DataFrame:
    """Bars of ticks that have idx and bar_index. Opens and closes go by idx, never by the order of arrival."""
    spread = F.col("askPrice") - F.col("bidPrice")
    std = F.stddev_samp if spec.ddof else F.stddev_pop
    cols = [F.min("timestamp").alias("timestamp") if spec.time == "first" else F.max("timestamp").alias("timestamp")]

    def ohlc(value, names):
        return [F.min_by(value, "idx").alias(names[0]), F.max(value).alias(names[1]), F.min(value).alias(names[2]), F.max_by(value, "idx").alias(names[3])]

    if spec.mid:
        cols += ohlc((F.col("askPrice") + F.col("bidPrice")) / 2, ("open", "high", "low", "close"))
    else:
        for side in ("bid", "ask"):
            cols += ohlc(F.col(f"{side}Price"), [f"{side}_{x}" for x in ("open", "high", "low", "close")])
    cols += [F.count("*").alias("tick_count"), F.avg(spread).alias("spread_mean"), std(spread).alias("spread_std")]
    if spec.detail:
        middle = (F.col("askPrice") + F.col("bidPrice")) / 2
        cols += [F.min_by(middle, "idx").alias("midPrice_first"), F.max_by(middle, "idx").alias("midPrice_last"), F.avg(middle).alias("midPrice_mean"), F.min(spread).alias("spread_min"), F.max(spread).alias("spread_max")]
    if "bidVolume" in indexed.columns and "askVolume" in indexed.columns:
        cols += [F.sum("bidVolume").alias("bidVolume_sum"), F.sum("askVolume").alias("askVolume_sum")]
    if spec.duration:
        cols.append(((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6).alias("bar_duration_sec"))
    return indexed.groupBy("symbol", "bar_index").agg(*cols)


def numbered(ticks: DataFrame) -> DataFrame:
    """ticks with idx, their number within the symbol; a source that numbers its ticks saves the pass."""
    return ticks if "idx" in ticks.columns else with_prefix(ticks, index="idx")


def tick_bars(ticks: DataFrame, spec: BarSpec) -> DataFrame:
    n = int(spec.threshold)
    indexed = numbered(ticks).withColumn("bar_index", F.floor(F.col("idx") / n))
    bars = aggregate(indexed, spec)
    return bars if spec.keep_partial else bars.where(F.col("tick_count") == n)


def _ends(amounts: np.ndarray, sums: np.ndarray, threshold: float) -> np.ndarray:
    """For each tick, the one that ends the bar which begins behind it; the number of ticks where none does.

    Found in running sums. Where those come so near to the threshold that rounding decides, the bar's own sum is taken.
    """
    n, level = len(sums), np.maximum.accumulate(sums)
    out = np.searchsorted(level, sums + threshold)
    rounding = 4.0 * n * np.finfo(float).eps * (abs(sums).max() + threshold)
    gap = np.minimum(abs(level[np.minimum(out, n - 1)] - sums - threshold), abs(level[np.maximum(out - 1, 0)] - sums - threshold))
    for i in np.flatnonzero(gap <= rounding).tolist():
        stop = int(out[i]) + 2
        while True:
            reached = np.add.accumulate(amounts[i + 1 : stop]) >= threshold
            if reached.any() or stop >= n:
                break
            stop += stop - i
        out[i] = i + 1 + int(reached.argmax()) if reached.any() else n
    return out


def _reset_steps(threshold: float):
    """A bar ends with the tick that brings its amount to the threshold, then the sum starts anew; missing amounts count as 0."""

    def steps(block: pa.Table) -> Steps:
        amounts = np.nan_to_num(block["_amount"].combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False))
        sums = np.cumsum(amounts)
        return Steps(np.maximum.accumulate(sums), sums + threshold, float(sums[-1]), threshold, _ends(amounts, sums, threshold))

    return steps


def reset_bars(ticks: DataFrame, spec: BarSpec) -> DataFrame:
    """Volume and dollar bars. Where a bar ends depends on where the last one did: a chain through the ticks, walked in blocks.

    A bar's sum is added up tick by tick, as a loop would; a bar that lies in two blocks adds up the sums of both parts."""
    if not {"bidVolume", "askVolume"} <= set(ticks.columns):
        return tick_bars(ticks, spec)
    v = F.col("bidVolume") + F.col("askVolume") if spec.kind == "volume" else F.col("bidPrice") * F.col("bidVolume") + F.col("askPrice") * F.col("askVolume")
    walked = along_chain(numbered(ticks).withColumn("_amount", v.cast("double")), "idx", _reset_steps(spec.threshold), ("_amount",), spec.threshold)
    return aggregate(walked.withColumn("bar_index", F.col("rank")), spec)


def cumulative_bars(ticks: DataFrame, spec: BarSpec, column: str | None = None) -> DataFrame:
    """Bars by what the running sum of volume divided by the threshold floors to; no reset, so it needs no order of tasks."""
    amount = F.col(column) if column else F.col("bidVolume") + F.col("askVolume")
    summed = with_prefix(ticks.drop("idx").withColumn("_amount", amount), sums={"_total": "_amount"}, index="idx")
    return aggregate(summed.withColumn("bar_index", F.floor(F.col("_total") / spec.threshold)), spec)


def build_bars(ticks: DataFrame, spec: BarSpec) -> DataFrame:
    return {"tick": tick_bars, "volume": reset_bars, "dollar": reset_bars, "volume_cum": cumulative_bars}[spec.kind](ticks, spec)


def heikin_ashi(bars: DataFrame, side: str = "bid", size: int | None = None) -> DataFrame:
    """bars with ha_open, ha_high, ha_low, ha_close of a side's prices (side None: columns without a prefix).

    The close is the mean of a bar's four prices; the open is the middle of the last Heikin-Ashi bar's open and close, at first of the bar's own;
    high and low reach to both. A symbol's bars are needed in order, in blocks of `size` that don't change the result.
    """
    o, h, low, c = (F.col(f"{side}_{x}" if side else x) for x in ("open", "high", "low", "close"))
    by = Window.partitionBy("symbol", "_block").orderBy("bar_index")
    # the close before a bar lies in its own block, or in the margin of one row that is copied to it
    spread = spread_blocks(bars.withColumn("ha_close", (o + h + low + c) / 4), 1, 0, size)
    before = spread.withColumn("_before", F.lag("ha_close").over(by)).where("_own").drop("_own", "_block")
    opened = affine_scan(before, "bar_index", F.lit(0.5), F.coalesce(F.col("_before") / 2, (o + c) / 2), "ha_open", size).drop("_before")
    return opened.withColumns({"ha_high": F.greatest(h, "ha_open", "ha_close"), "ha_low": F.least(low, "ha_open", "ha_close")})


def average_duration(bars: DataFrame) -> DataFrame:
    """symbol, seconds: (last - first timestamp) / number of bars; 60 where there is one bar."""
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    return bars.groupBy("symbol").agg(F.when(F.count("*") > 1, span / F.count("*")).otherwise(60.0).alias("seconds"))
