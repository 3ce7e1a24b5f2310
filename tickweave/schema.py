"""Tables of the engine and adapters that make ticks from other tables.

Ticks are (symbol, seq, timestamp, bidPrice, askPrice, bidVolume, askVolume), ordered by (timestamp, seq) within a symbol.
Time zones are UTC throughout. NaN becomes null at every source, so that comparisons treat it as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.prefix import with_prefix

TICK = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("bidPrice", T.DoubleType()),
        T.StructField("askPrice", T.DoubleType()),
        T.StructField("bidVolume", T.DoubleType()),
        T.StructField("askVolume", T.DoubleType()),
    ]
)

#: Columns of a label table. None of them may become a feature: they know the future.
LABEL_COLUMNS = ("event_start", "event_end", "label", "bar_index_start", "bar_index_end", "entry_price", "exit_price", "pnl", "barrier_hit", "effective_horizon", "bar_timestamp")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def ticks_from_events(events: DataFrame, symbol: Column | str = "EV", index: str | None = None) -> DataFrame:
    """Quotes from the events table: the bid walks by steps that each event's props give, all prices exact in binary.

    index names a column for the tick's number within its symbol, which the same pass gives.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.select(
        (F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        ((2 * k - 99) / F.lit(2048.0)).alias("step"),
        k.cast("double").alias("bidVolume"),
        (1 + (F.col("event_id") * 7) % 50).cast("double").alias("askVolume"),
    )
    walked = with_prefix(rows, sums={"walk": "step"}, index=index)
    bid = 100 + F.col("walk")
    return walked.select("symbol", "seq", "timestamp", bid.alias("bidPrice"), (bid + (1 + F.col("seq") % 5) / F.lit(64.0)).alias("askPrice"), "bidVolume", "askVolume", *([index] if index else []))


def ticks_from_lineitem(lineitem: DataFrame, symbol: str = "LI") -> DataFrame:
    """A large tick table without times of day: one quote for each line, numbered in a total order."""
    order = F.xxhash64("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    price = F.round("l_extendedprice").cast("long") / F.lit(128.0)
    return lineitem.select(F.lit(symbol).alias("symbol"), order.alias("seq"), F.col("l_shipdate").cast("timestamp").alias("timestamp"), price.alias("bidPrice"), (price + F.lit(1 / 64)).alias("askPrice"), F.col("l_quantity").alias("bidVolume"), F.col("l_quantity").alias("askVolume"))


def dirty_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks with repeated timestamps, zero spreads and spikes put in, to exercise cleaning."""
    spiked = ticks.withColumn("askPrice", F.when(F.col("seq") % 53 == 0, F.col("bidPrice")).otherwise(F.col("askPrice")))
    jump = F.when(F.col("seq") % 211 == 0, 8).otherwise(1)
    spiked = spiked.withColumns({"bidPrice": F.col("bidPrice") * jump, "askPrice": F.col("askPrice") * jump})
    return spiked.unionByName(spiked.where("seq % 97 = 0").withColumn("seq", F.col("seq") + 1_000_000_000))
