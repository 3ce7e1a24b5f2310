"""Bars of a stream of ticks, by number of ticks or by volume: what a symbol's bars depend on is kept as state.

Tasks first pack the ticks that arrive into pieces, each a symbol's ticks of one bucket of time. Pieces wait as they are until the watermark has passed
their bucket's end; a timer then takes its ticks in the order of (timestamp, seq), all bars that they end at once. So the order of arrival within the watermark's delay does not matter, and bars are those of the table
of all ticks, in whatever micro-batches they come and wherever the query is stopped and started again from its checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.stored import scratch_path, stored
from ..operators.bars import BarSpec

# a stream's first Python worker knows nothing of the driver's search path: the processor travels with its code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TICK = np.dtype([("micros", "<i8"), ("seq", "<i8"), ("bid", "<f8"), ("ask", "<f8"), ("bv", "<f8"), ("av", "<f8")])

#: Of a symbol: ticks and amount so far, the open bar's number and amount, and what the open bar has of its ticks (n of them).
_OPEN = "idx long, total double, bar long, held double, n long, first long, last long, bid array<double>, ask array<double>, mean double, m2 double, bv double, av double, idle long"
_BAR = "symbol string, bar_index long, timestamp timestamp, bid_open double, bid_high double, bid_low double, bid_close double, ask_open double, ask_high double, ask_low double, ask_close double, tick_count long, spread_mean double, spread_std double, bidVolume_sum double, askVolume_sum double"
_COLUMNS = [c.split()[0] for c in _BAR.split(", ")]
_DOUBLES = {c.split()[0]: float for c in _BAR.split(", ") if c.endswith(" double")}
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Ticks that a task holds at once while it packs. Results don't depend on it.
PACK = 1 << 19


def _packing(width: int):
    """Rows of ticks -> pieces: symbol, bucket, the latest time, the ticks. Rows without prices give a time only."""

    def pieces(table: pa.Table) -> pa.RecordBatch:
        coded = table["symbol"].combine_chunks().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ticks = np.empty(len(table), _TICK)
        for own, column in (("micros", "micros"), ("seq", "seq"), ("bid", "bidPrice"), ("ask", "askPrice"), ("bv", "bidVolume"), ("av", "askVolume")):
            ticks[own] = table[column].to_numpy()
        order = np.lexsort((buckets := ticks["micros"] // (1000 * width), codes))
        ticks, buckets, codes = ticks[order], buckets[order], codes[order]
        cuts = np.flatnonzero((np.diff(buckets) != 0) | (np.diff(codes) != 0)) + 1
        starts, parts = np.append(0, cuts), np.split(ticks, cuts)
        priced = [p[~(np.isnan(p["bid"]) & np.isnan(p["ask"]))].tobytes() for p in parts]
        symbols = [None if c < 0 else names[c] for c in codes[starts].tolist()]
        return pa.record_batch([pa.array(symbols, pa.string()), pa.array(buckets[starts]), pa.array([int(p["micros"].max()) for p in parts], pa.int64()), pa.array(priced, pa.binary())], names=["symbol", "bucket", "micros", "ticks"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held, n = [*held, batch], n + batch.num_rows
            if n >= PACK:
                yield pieces(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pieces(pa.Table.from_batches(held))

    return work


class _Open:
    """The open bar of a symbol; takes ticks in order and gives the bars that they end."""

    def __init__(self, spec: SimpleNamespace, state: tuple | None):
        self.spec = spec
        if state is None:
            self.idx, self.total, self.bar, self.held, self.idle = 0, 0.0, 0, 0.0, 0
            self.clear()
        else:
            self.idx, self.total, self.bar, self.held, self.n, self.first, self.last, self.bid, self.ask, self.mean, self.m2, self.bv, self.av, self.idle = state
            self.bid, self.ask = list(self.bid or []), list(self.ask or [])

    def clear(self) -> None:
        self.n, self.first, self.last, self.bid, self.ask, self.mean, self.m2, self.bv, self.av = 0, 0, 0, [], [], 0.0, 0.0, None, None

    def state(self) -> tuple:
        return (self.idx, self.total, self.bar, self.held, self.n, self.first, self.last, self.bid, self.ask, self.mean, self.m2, self.bv, self.av, self.idle)

    def _numbers(self, ticks: np.ndarray) -> tuple[np.ndarray, bool]:
        """The bar of each tick, and whether the last tick ends its bar."""
        kind, most = self.spec.kind, self.spec.threshold
        if kind == "tick":
            most = int(most)
            at = self.idx + np.arange(len(ticks))
            return at // most, bool((at[-1] + 1) % most == 0)
        amounts = np.nan_to_num(ticks["bid"] * ticks["bv"] + ticks["ask"] * ticks["av"] if kind == "dollar" else ticks["bv"] + ticks["av"])
        if kind == "volume_cum":
            sums = np.add.accumulate(np.append(self.total, amounts))[1:]
            self.total = float(sums[-1])
            return np.floor(sums / most).astype(np.int64), False
        out, bar, held, ended = np.empty(len(ticks), np.int64), self.bar, self.held, False
        for i, x in enumerate(amounts.tolist()):
            out[i], held = bar, held + x
            if ended := held >= most:
                bar, held = bar + 1, 0.0
        self.held = held
        return out, ended

    def _add(self, ticks: np.ndarray) -> None:
        """Ticks of the open bar, in order."""
        for side in ("bid", "ask"):
            price, have = ticks[side], getattr(self, side)
            if have:
                have[1], have[2], have[3] = float(max(have[1], price.max())), float(min(have[2], price.min())), float(price[-1])
            else:
                setattr(self, side, [float(x) for x in (price[0], price.max(), price.min(), price[-1])])
        spread, k = ticks["ask"] - ticks["bid"], len(ticks)
        gap, both = float(spread.mean()) - self.mean, self.n + k
        self.m2 += float(((spread - spread.mean()) ** 2).sum()) + gap * gap * self.n * k / both
        self.mean += gap * k / both
        for own, volume in (("bv", ticks["bv"]), ("av", ticks["av"])):
            known = volume[~np.isnan(volume)]
            if len(known):
                setattr(self, own, (getattr(self, own) or 0.0) + float(known.sum()))
        self.first = self.first if self.n else int(ticks["micros"][0])
        self.last, self.n = int(ticks["micros"][-1]), both

    def close(self, symbol: str | None) -> tuple:
        ddof, time = (1 if self.spec.ddof else 0), self.first if self.spec.time == "first" else self.last
        std = float(np.sqrt(self.m2 / (self.n - ddof))) if self.n > ddof else None
        out = (symbol, self.bar, pd.Timestamp(time, unit="us", tz="UTC"), *self.bid, *self.ask, self.n, self.mean, std, self.bv, self.av)
        self.clear()
        return out

    def _whole(self, symbol: str | None, ticks: np.ndarray, numbers: np.ndarray) -> pd.DataFrame:
        """Bars of which all ticks are here."""
        starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        ends, n = np.append(starts[1:], len(ticks)) - 1, np.diff(starts, append=len(ticks))
        ddof, spread = (1 if self.spec.ddof else 0), ticks["ask"] - ticks["bid"]
        mean = np.add.reduceat(spread, starts) / n
        m2 = np.add.reduceat((spread - np.repeat(mean, n)) ** 2, starts)
        out = {"symbol": np.full(len(n), symbol, object), "bar_index": numbers[starts], "timestamp": pd.to_datetime(ticks["micros"][starts if self.spec.time == "first" else ends], unit="us", utc=True)}
        for side in ("bid", "ask"):
            price = np.ascontiguousarray(ticks[side])
            out |= {f"{side}_open": price[starts], f"{side}_high": np.maximum.reduceat(price, starts), f"{side}_low": np.minimum.reduceat(price, starts), f"{side}_close": price[ends]}
        out |= {"tick_count": n, "spread_mean": mean, "spread_std": np.where(n > ddof, np.sqrt(m2 / np.maximum(n - ddof, 1)), np.nan)}
        for name, own in (("bidVolume_sum", "bv"), ("askVolume_sum", "av")):
            known = ~np.isnan(ticks[own])
            out[name] = np.where(np.logical_or.reduceat(known, starts), np.add.reduceat(np.where(known, ticks[own], 0.0), starts), np.nan)
        return pd.DataFrame(out, columns=_COLUMNS)

    def taken(self, symbol: str | None, ticks: np.ndarray) -> list[pd.DataFrame]:
        """The bars that these ticks, in order, end."""
        if not len(ticks):
            return []
        numbers, ended = self._numbers(ticks)
        self.idx += len(ticks)
        out = []
        if self.n:
            other = np.flatnonzero(numbers != self.bar)
            head = int(other[0]) if len(other) else len(ticks)
            if head:
                self._add(ticks[:head])
            if head < len(ticks) or ended:
                out.append(_frame([self.close(symbol)]))
            ticks, numbers = ticks[head:], numbers[head:]
        if len(ticks):
            other = np.flatnonzero(numbers != numbers[-1])
            last = len(ticks) if ended else int(other[-1]) + 1 if len(other) else 0
            if last:
                out.append(self._whole(symbol, ticks[:last], numbers[:last]))
            self.bar = int(numbers[-1])
            if last < len(ticks):
                self._add(ticks[last:])
        self.bar += ended
        return out

    def take(self, symbol: str | None, ticks: np.ndarray) -> list[tuple]:
        """taken() as rows."""
        return [row for bars in self.taken(symbol, ticks) for row in bars.itertuples(index=False, name=None)]


def _frame(bars: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(bars, columns=_COLUMNS).astype(_DOUBLES)


class BarProcessor(StatefulProcessor):
    """Keeps a symbol's pending ticks and open bar. width is a bucket's in milliseconds; idle, after how long without ticks an open bar is closed."""

    def __init__(self, spec: SimpleNamespace, width: int, idle: int | None):
        self.spec, self.width, self.idle = spec, width, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.parts = handle.getMapState("parts", "bucket long", "n long")  # how many pieces of a bucket wait
        self.pending = handle.getMapState("pieces", "bucket long, part long", "ticks binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for bucket, ticks in zip(part["bucket"].tolist(), part["ticks"], strict=True):
                end = (bucket + 1) * self.width
                if end <= passed or not ticks:
                    continue  # too late: the bucket's ticks are taken
                n = self.parts.getValue((bucket,))[0] if self.parts.containsKey((bucket,)) else 0
                if not n:
                    self.handle.registerTimer(end)
                self.pending.updateValue((bucket, n), (bytes(ticks),))
                self.parts.updateValue((bucket,), (n + 1,))
        return iter(())

    def _waiting(self, bucket: int) -> np.ndarray:
        """A bucket's ticks in order, which from now on no longer wait."""
        pieces = [(bucket, i) for i in range(self.parts.getValue((bucket,))[0])]
        ticks = np.concatenate([np.frombuffer(bytes(self.pending.getValue(p)[0]), _TICK) for p in pieces])
        for p in pieces:
            self.pending.removeKey(p)
        self.parts.removeKey((bucket,))
        return ticks[np.lexsort((ticks["seq"], ticks["micros"]))]

    def _rest(self, symbol: str | None, bar: _Open) -> list[pd.DataFrame]:
        """The open bar, closed as it is."""
        bar.idle = 0
        if not bar.n:
            return []
        out = [_frame([bar.close(symbol)])]
        bar.bar, bar.held = bar.bar + (self.spec.kind != "volume_cum"), 0.0
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        bar, out, bucket = _Open(self.spec, self.open.get() if self.open.exists() else None), [], at // self.width - 1
        if at % self.width == 0 and self.parts.containsKey((bucket,)):
            out = bar.taken(key[0], self._waiting(bucket))
            if self.idle is not None:
                if bar.idle:
                    self.handle.deleteTimer(bar.idle)
                bar.idle = at + self.idle
                if bar.idle > timerValues.getCurrentWatermarkInMs():
                    self.handle.registerTimer(bar.idle)
                elif all((b + 1) * self.width > bar.idle for (b,) in self.parts.keys()):
                    out += self._rest(key[0], bar)  # a timer in the past would wait for the next batch
        elif at == bar.idle:
            out = self._rest(key[0], bar)
        self.open.update(bar.state())
        yield from out


def _milliseconds(spark: SparkSession, interval: str) -> int:
    return int(spark.sql(f"select cast(unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {interval}) as bigint)").first()[0])


def stateful_bars(ticks: DataFrame, spec: BarSpec, late: str = "10 minutes", width: str = "1 minute", idle: str | None = None) -> DataFrame:
    """The bars of operators.bars.build_bars() for a stream of ticks, each as soon as the watermark has passed its last tick (append mode).

    Ticks may come in any order within `late`; later ones are dropped, unless their bucket of `width` still waits. A row without prices is no tick but moves the watermark on. A bar left
    open is closed after `idle` without ticks, if that is given; tick bars only with keep_partial. Bars of mid prices, with details or
    durations are made from tables only. The session must keep state in RocksDB (see rocksdb_state()).
    """
    if spec.mid or spec.detail or spec.duration:
        raise ValueError("streams have bars of bid and ask prices without details or durations")
    spark = ticks.sparkSession
    if idle is not None and spec.kind == "tick" and not spec.keep_partial:
        idle = None
    span = _milliseconds(spark, width)
    rows = ticks.where(F.col("timestamp").isNotNull()).select("symbol", F.unix_micros("timestamp").alias("micros"), F.coalesce("seq", F.lit(0)).alias("seq"), *[F.col(c).cast("double").alias(c) for c in ("bidPrice", "askPrice", "bidVolume", "askVolume")])
    pieces = rows.mapInArrow(_packing(span), "symbol string, bucket long, micros long, ticks binary")
    pieces = pieces.select("symbol", "bucket", "ticks", F.timestamp_micros("micros").alias("timestamp")).withWatermark("timestamp", late)
    processor = BarProcessor(SimpleNamespace(**asdict(spec)), span, None if idle is None else _milliseconds(spark, idle))
    return pieces.groupBy("symbol").transformWithStateInPandas(processor, _BAR, "append", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession, partitions: int | None = None):
    """Streams that start within keep their state in RocksDB, in so many partitions (fixed for a checkpoint's life)."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _PROVIDER, "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_available(bars: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream of bars over what its source has now, appends to Parquet at path, and stops; the checkpoint continues it."""
    bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def replayed_bars(ticks: DataFrame, spec: BarSpec, slices: int = 2) -> DataFrame:
    """The bars that a stream of this table gives: files arrive slice by slice of time, the query is stopped and started again after each.

    A slice's ticks are dealt over two files, each a micro-batch of its own. A last row without prices moves the watermark past everything,
    so that open bars are closed. Results are those of build_bars(), but for rows without prices.
    """
    spark = ticks.sparkSession
    source, out, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("ticks", "bars", "checkpoint"))
    table = stored(ticks.select("symbol", "seq", "timestamp", "bidPrice", "askPrice", "bidVolume", "askVolume"), "ticks")
    first, last = table.agg(F.unix_millis(F.min("timestamp")).alias("a"), F.unix_millis(F.max("timestamp")).alias("b")).first()
    if first is None:
        return spark.createDataFrame([], _BAR)
    width = (last - first) // slices + 1
    late, bucket = f"{width} milliseconds", f"{max(1, -(-width // 100))} milliseconds"
    with rocksdb_state(spark):
        for k in range(slices + 1):
            if k < slices:
                at = F.floor((F.unix_millis("timestamp") - first) / width)
                table.where(at == k).repartition(2, "seq").write.mode("append").option("parquet.block.size", 16 << 20).parquet(source)  # blocks that tasks can share
            else:
                nothing = [F.lit(None).cast("double").alias(c) for c in ("bidPrice", "askPrice", "bidVolume", "askVolume")]
                end = spark.range(1).select(F.lit("").alias("symbol"), F.lit(None).cast("long").alias("seq"), F.timestamp_millis(F.lit(last + 3 * width + 40 * 86_400_000)).alias("timestamp"), *nothing)
                end.write.mode("append").parquet(source)
            stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
            write_available(stateful_bars(stream, spec, late, bucket, idle=f"{width + 86_400_000} milliseconds"), out, checkpoint)
    return spark.read.schema(_BAR).parquet(out)
