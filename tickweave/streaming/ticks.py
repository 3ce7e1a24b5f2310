"""Bars and clean ticks from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_stream(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first tick that arrives for each symbol and timestamp, within the watermark; zero and negative spreads go."""
    return ticks.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["symbol", "timestamp"]).where("askPrice > bidPrice")


def time_bars(ticks: DataFrame, width: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Bars of equal time, for a stream (append mode) as for a table; late is None where the stream has a watermark already. Opens and closes go by (timestamp, seq)."""
    at = F.struct("timestamp", "seq")
    prices = [f.alias(f"{side}_{name}") for side in ("bid", "ask") for name, f in (("open", F.min_by(f"{side}Price", at)), ("high", F.max(f"{side}Price")), ("low", F.min(f"{side}Price")), ("close", F.max_by(f"{side}Price", at)))]
    spread = F.col("askPrice") - F.col("bidPrice")
    watched = ticks.withWatermark("timestamp", late) if ticks.isStreaming and late else ticks
    bars = watched.groupBy("symbol", F.window("timestamp", width).alias("w")).agg(*prices, F.count("*").alias("tick_count"), F.avg(spread).alias("spread_mean"), F.sum("bidVolume").alias("bidVolume_sum"), F.sum("askVolume").alias("askVolume_sum"))
    return bars.withColumn("timestamp", F.col("w.start")).drop("w")
