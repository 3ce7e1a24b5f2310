"""The first bar ahead that reaches a level, searched in blocks of bars: no list of the bars ahead is ever made for a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import spread_blocks

#: What ended a search: nothing but its length, the upper level, the lower one, a bar that halts.
NONE, UP, DOWN, HALT = range(4)

_FOUND = "exit_bar long, exit_micros long, exit_close double, outcome int"


def first_reach(bars: DataFrame, up: Column, down: Column, ahead: Column, longest: int, halt: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """symbol, bar_index, timestamp, the numbers named in keep, exit_bar, exit_timestamp, exit_close and outcome.

    A row for each bar whose `ahead` is 1 or more and that has a next bar. Of its next `ahead` bars (`longest` at most) the
    first whose bid_high is `up` or more, whose bid_low is `down` or less, or that halts ends the search; else the last of
    them. A bar that does several counts as HALT, then UP, then DOWN.
    """
    spread = spread_blocks(bars, 0, longest)
    asks = F.when(F.col("_own"), F.least(F.coalesce(ahead, F.lit(0)), F.lit(longest))).otherwise(0).cast("long")
    rows = spread.select("symbol", "_block", "bar_index", F.unix_micros("timestamp").alias("_micros"), "bid_high", "bid_low", "bid_close", up.cast("double").alias("_up"), down.cast("double").alias("_down"), asks.alias("_ahead"), F.coalesce(F.lit(False) if halt is None else halt, F.lit(False)).alias("_halt"), *[F.col(c).alias(f"_keep_{c}") for c in keep])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_index", kind="stable")
        high, low, close, top, bottom = (rows[c].to_numpy(float) for c in ("bid_high", "bid_low", "bid_close", "_up", "_down"))
        length, halts, n = rows["_ahead"].to_numpy(np.int64), rows["_halt"].to_numpy(bool), len(rows)
        asking = np.flatnonzero(length > 0)
        asking = asking[asking + 1 < n]
        end, outcome, left, k = np.full(n, -1), np.zeros(n, np.int32), asking, 1
        while len(left):
            over = (left + k >= n) | (k > length[left])
            end[left[over]] = left[over] + k - 1
            left = left[~over]
            at = left + k
            found = np.where(halts[at], HALT, np.where(high[at] >= top[left], UP, np.where(low[at] <= bottom[left], DOWN, NONE)))
            done = found != NONE
            end[left[done]], outcome[left[done]] = at[done], found[done]
            left, k = left[~done], k + 1
        at, out = end[asking], rows.iloc[asking].drop(columns=["_block", "bid_high", "bid_low", "bid_close", "_up", "_down", "_ahead", "_halt"])
        return out.assign(exit_bar=rows["bar_index"].to_numpy()[at], exit_micros=rows["_micros"].to_numpy()[at], exit_close=close[at], outcome=outcome[asking])

    kinds = dict(bars.dtypes)
    schema = f"symbol {kinds['symbol']}, bar_index long, _micros long, {''.join(f'_keep_{c} {kinds[c]}, ' for c in keep)}{_FOUND}"
    found = rows.groupBy("symbol", "_block").applyInPandas(search, schema)
    return found.select("symbol", "bar_index", F.timestamp_micros("_micros").alias("timestamp"), *[F.col(f"_keep_{c}").alias(c) for c in keep], "exit_bar", F.timestamp_micros("exit_micros").alias("exit_timestamp"), "exit_close", "outcome")
