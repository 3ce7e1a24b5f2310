import random
import sys
from dataclasses import asdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tickweave.operators import bars
from tickweave.streaming import bars as stream


def open_bar(spec, state=None):
    return stream._Open(SimpleNamespace(**asdict(spec)), state)


def some_ticks(n, seed=1):
    rng = random.Random(seed)
    rows = [(1_000_000 * i, i, 100 + rng.randrange(9), 101 + rng.randrange(9) / 4, float(rng.randrange(50)), float(rng.randrange(9)) if i % 5 else np.nan) for i in range(n)]
    return np.array(rows, stream._TICK)


@pytest.mark.parametrize("spec", [bars.BarSpec("tick", 7), bars.BarSpec("volume", 90.0), bars.BarSpec("dollar", 5000.0), bars.BarSpec("volume_cum", 64.0, time="last", ddof=0)])
def test_bars_are_the_same_however_ticks_come(spec):
    ticks = some_ticks(200)
    whole = open_bar(spec)
    expected = whole.take("S", ticks)
    assert len(expected) > 10
    for seed in range(5):
        rng, bar, got, at = random.Random(seed), open_bar(spec), [], 0
        while at < len(ticks):
            step = rng.randrange(1, 20)
            got += bar.take("S", ticks[at : at + step])
            at += step
            bar = open_bar(spec, bar.state())  # as if read back from the checkpoint
        assert [g[:12] for g in got] == [e[:12] for e in expected]
        np.testing.assert_allclose([[np.nan if x is None else x for x in g[12:]] for g in got], [[np.nan if x is None else x for x in e[12:]] for e in expected])
        assert bar.state()[:4] == whole.state()[:4]


def test_a_stream_that_is_stopped_and_started_again(spark):
    rng = random.Random(3)
    rows = [(rng.choice(("A", "B", None)), i, 1000 + i // 2, 1.0 + rng.randrange(8), 9.5 + rng.randrange(4), float(rng.randrange(30)), 1.0) for i in range(240)] + [("one", 500, 1060, 1.0, 2.0, 3.0, 4.0)]
    ticks = spark.createDataFrame(rows, "symbol string, seq long, t long, bidPrice double, askPrice double, bidVolume double, askVolume double").withColumn("timestamp", F.timestamp_seconds("t"))
    spec = bars.BarSpec("volume", 100.0)
    got, expected = (x.select("symbol", "bar_index", "timestamp", "bid_open", "bid_high", "bid_low", "bid_close", "ask_open", "ask_close", "tick_count", "bidVolume_sum", F.round("spread_std", 9).alias("std")).collect() for x in (stream.replayed_bars(ticks, spec), bars.build_bars(ticks, spec)))
    assert sorted(map(repr, got)) == sorted(map(repr, expected)) and len(got) > 20
    assert stream.replayed_bars(ticks.limit(0), spec).count() == 0


def test_late_ticks_are_dropped_and_bars_without_ticks_are_closed(spark, tmp_path):
    ticks = spark.createDataFrame([("A", 1, 1000), ("A", 2, 1060), ("A", 3, 1600), ("A", 4, 1030), ("A", 5, 10_000), ("A", 6, 10_001)], "symbol string, seq long, t long")
    ticks = ticks.select("symbol", "seq", F.timestamp_seconds("t").alias("timestamp"), F.lit(1.0).alias("bidPrice"), F.lit(2.0).alias("askPrice"), F.lit(1.0).alias("bidVolume"), F.lit(1.0).alias("askVolume"))
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    with stream.rocksdb_state(spark, 2):
        for seqs in ((1, 2, 3), (4,), (5,), (6,)):  # the fourth tick comes when ticks up to 1570 s are taken
            ticks.where(F.col("seq").isin(*seqs)).coalesce(1).write.mode("append").parquet(source)
            read = spark.readStream.schema(ticks.schema).parquet(source)
            stream.write_available(stream.stateful_bars(read, bars.BarSpec("volume", 1000.0), "30 seconds", "10 seconds", idle="20 minutes"), out, checkpoint)
    got = spark.read.parquet(out).collect()
    assert [(r.bar_index, r.tick_count) for r in got] == [(0, 3)]
    with pytest.raises(ValueError):
        stream.stateful_bars(ticks, bars.BarSpec("tick", 5, mid=True))


class _State(dict):
    """Map and value state that counts what is written."""

    written = 0
    containsKey, removeKey, exists = dict.__contains__, dict.__delitem__, dict.__len__

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value
        self.written += sum(len(x) for x in value if isinstance(x, bytes))

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value


def test_waiting_ticks_are_written_once_and_bars_made_together():
    rows = stream._TICK.itemsize
    rng, ticks = np.random.default_rng(5), some_ticks(30_000)
    dealt = ticks[rng.permutation(len(ticks))]
    columns = dict(zip(("micros", "seq", "bidPrice", "askPrice", "bidVolume", "askVolume"), stream._TICK.names, strict=True))
    states, timers = {}, set()
    handle = SimpleNamespace(registerTimer=timers.add, deleteTimer=timers.discard)
    handle.getValueState = handle.getMapState = lambda name, *_: states.setdefault(name, _State())
    spec = bars.BarSpec("volume", 90.0)
    processor = stream.BarProcessor(SimpleNamespace(**asdict(spec)), 600_000, None)
    processor.init(handle)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    for part in np.split(dealt, 100):  # each part has ticks of every bucket
        batch = pa.record_batch({"symbol": ["S"] * len(part)} | {c: part[own] for c, own in columns.items()})
        for piece in stream._packing(600_000)(iter([batch])):
            assert piece.num_rows == len(set(part["micros"] // 600_000_000)) and list(processor.handleInputRows(("S",), iter([piece.to_pandas()]), now)) == []
    assert sum(s.written for s in states.values()) == len(ticks) * rows
    got = [b for at in sorted(timers) for b in processor.handleExpiredTimer(("S",), now, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))]
    calls, whole = [0], open_bar(spec)
    sys.setprofile(lambda *_: calls.__setitem__(0, calls[0] + 1))
    try:
        expected = whole.taken("S", ticks)
    finally:
        sys.setprofile(None)
    (expected,), got = expected, pd.concat(got, ignore_index=True)
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)
    assert len(expected) > 5000 and calls[0] < 2 * len(expected) and not states["pieces"] and not states["parts"]
    slow = open_bar(spec)
    one_by_one = [row for i in range(2000) for row in slow.take("S", ticks[i : i + 1])]
    pd.testing.assert_frame_equal(stream._frame(one_by_one), expected[: len(one_by_one)], check_dtype=False)
