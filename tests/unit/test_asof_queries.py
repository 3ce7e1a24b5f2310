"""The as-of queries give every tick a bar, held against a search."""

import datetime as dt
import os
from bisect import bisect_left, bisect_right

import pytest
from tickweave import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_every_tick_is_joined(spark):
    ticks = registry._ticks(spark, SF).select("seq", "timestamp").collect()
    bars = sorted((r.timestamp, r.bar_index, r.bid_close) for r in registry._bars(spark, SF).select("timestamp", "bar_index", "bid_close").collect())
    times = [b[0] for b in bars]
    back, near = {}, {}
    for r in ticks:
        at = r.timestamp + dt.timedelta(seconds=11)
        p, n = bisect_right(times, at) - 1, bisect_left(times, at)
        back[r.seq] = bars[p][1:] if p >= 0 else (None, None)
        k = n if p < 0 or (n < len(times) and times[n] - at <= at - times[p]) else p
        near[r.seq] = bars[k][1:]
    for name, want in (("asof_backward", back), ("asof_signal", near)):
        got = registry.queries()[name](spark, SF).collect()
        assert len(got) == len(ticks) and {r.seq: (r.bar_index, r.bid_close) for r in got} == want
