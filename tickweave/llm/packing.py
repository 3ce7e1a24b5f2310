"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

A document's ids are followed by id 0; what is longer than a sequence is cut into full pieces, a first piece taking the
rest. Full pieces are sequences already. The others are dealt at random into blocks of about BLOCK pieces, each packed on
several islands (a row each). An island starts from plain best fit decreasing and from packings made in random order, which
are poorer and unlike each other, and makes GENERATIONS crossovers an epoch, always: whole well-filled bins of one parent are
injected into the other, the bins that hold the same pieces are removed, and the pieces so displaced are best-fitted, largest
first; nothing else changes a packing. Between epochs each island's elite migrates to the next island of its block (a join on
block and island). No row depends on another block, whatever the size of the input. The result says how many crossovers stand
behind a piece's block and how many sequences they saved over plain best fit decreasing of that block; it is never worse.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, slices, with_defaults

CAPACITY = 2048

#: Pieces of a block, islands, population of each, generations (one crossover each) of an epoch, epochs.
BLOCK, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 8192, 3, 6, 24, 3

#: The share of a packing's bins, the fullest, that count as well filled.
WELL_FILLED = 0.25

_SPECIAL = "<|endoftext|>"
#: Beyond these characters the two libraries might hold to different Unicode versions.
_UNCOMMON = re.compile("[^\x00-ɏ‐-‧]")


@cache
def _slow(json_path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@cache
def _fast(ranks_path: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """Ids that tokenizers gives with add_special_tokens=False, and then 0.

    tiktoken reads the same vocabulary several times faster; it is used where the text holds neither the special
    token nor uncommon characters, for which ids are the same.
    """
    if _SPECIAL in text or _UNCOMMON.search(text):
        ids = np.array(_slow(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
    else:
        ids = _fast(ranks_path).encode_to_numpy(text, disallowed_special=())
    return np.append(ids, np.uint32(0)).astype("<u4")


def tokenize(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 per piece of each row of docs; null text is empty."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for k, text in enumerate(batch.column(1)):
                ids = token_ids(text.as_py() or "", json_path, ranks_path)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            at, *rest = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.record_batch([batch.column(0).take(pa.array(at)), *map(pa.array, rest)], names=["doc_id", "piece", "start", "length", "ids_crc32"]).cast(_PIECES)

    return with_defaults(docs, doc_id="long", text="string").mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def best_fit(items: np.ndarray, lengths: np.ndarray, bins: np.ndarray, loads: list[int], capacity: int) -> None:
    """Put each item, in the order given, into the fullest bin that has room; a new one where none has. In place."""
    room = sorted((capacity - load) << 32 | b for b, load in enumerate(loads) if load < capacity)
    for item, size in zip(items.tolist(), lengths[items].tolist(), strict=True):
        at = bisect_left(room, size << 32)
        if at < len(room):
            b = room.pop(at) & 0xFFFFFFFF
        else:
            b = len(loads)
            loads.append(0)
        bins[item] = b
        loads[b] += size
        if loads[b] < capacity:
            insort(room, (capacity - loads[b]) << 32 | b)


def _compact(bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bins numbered without gaps in the same order, and their loads."""
    used = np.bincount(bins) > 0
    bins = (np.cumsum(used) - 1)[bins]
    return bins.astype(np.int32), np.bincount(bins, lengths).astype(np.int64).tolist()


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Fewer bins first, then fullness gathered in few of them."""
    loads = np.bincount(bins, lengths) / capacity
    return float(-len(loads) + (loads**2).mean())


def _packing(order: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit in this order."""
    bins = np.full(len(lengths), -1, np.int32)
    best_fit(order, lengths, bins, [], capacity)
    return bins


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    return _packing(np.argsort(-lengths, kind="stable"), lengths, capacity)


def _well_filled(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bins as full as the fullest WELL_FILLED of all: full ones, once there are so many."""
    loads = np.bincount(bins, lengths)
    return loads >= np.quantile(loads, 1 - WELL_FILLED, method="lower")


def crossover(rng: np.random.Generator, mother: np.ndarray, father: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Mother's packing with half of father's well-filled bins; every item stays packed once.

    Displaced are the other items of those of mother's bins that hold an injected one.
    """
    well = np.flatnonzero(_well_filled(father, lengths))
    injected, met = np.zeros(int(father.max()) + 1, bool), np.zeros(int(mother.max()) + 1, bool)
    injected[rng.choice(well, -(-len(well) // 2), replace=False)] = True
    chosen = injected[father]
    met[mother[chosen]] = True
    displaced = np.flatnonzero(met[mother] & ~chosen)
    child = mother.copy()
    child[chosen] = father[chosen] + mother.max() + 1
    child[displaced] = -1
    keep = child >= 0
    packed, loads = _compact(child[keep], lengths[keep])
    child[keep] = packed
    best_fit(displaced[np.argsort(-lengths[displaced], kind="stable")], lengths, child, loads, capacity)
    return child


def evolve(lengths: np.ndarray, members: list[np.ndarray], seed: int, capacity: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """A population after so many crossovers, best first. A new one is best fit decreasing and packings in random order."""
    rng = np.random.default_rng(seed)
    members = members or [best_fit_decreasing(lengths, capacity)]
    members = [*members, *(_packing(rng.permutation(len(lengths)), lengths, capacity) for _ in range(POPULATION - len(members)))]
    scored = sorted([(fitness(m, lengths, capacity), -i, m) for i, m in enumerate(members)], reverse=True)
    for born in range(generations):
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(rng, scored[min(a, b)][2], scored[max(a, b)][2], lengths, capacity)
        # of equals the older stay in front
        insort(scored, (fitness(child, lengths, capacity), -len(members) - born, child), key=lambda m: (-m[0], -m[1]))
        scored = scored[:POPULATION]
    return [m for *_, m in scored]


def _evolution(capacity: int, epoch: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packings, scores, first = [], [], []
            for block, island, lengths, have, guest, start in zip(*(batch.column(c) for c in ("block", "island", "lengths", "packings", "guest", "start_bins")), strict=True):
                sizes = np.array(lengths.as_py(), np.int64)
                members = [np.array(m, np.int32) for m in (have.as_py() or [])]
                if guest.as_py() is not None:
                    members = [*members[: POPULATION - 1], np.array(guest.as_py(), np.int32)]
                seed = (block.as_py() * EPOCHS + epoch) * ISLANDS + island.as_py()
                if not members:
                    members = evolve(sizes, [], seed, capacity, 0)
                first.append(start.as_py() or int(best_fit_decreasing(sizes, capacity).max()) + 1)
                members = evolve(sizes, members, seed, capacity)
                packings.append([m.tolist() for m in members])
                scores.append(fitness(members[0], sizes, capacity))
            made = [pa.array(packings, pa.list_(pa.list_(pa.int32()))), pa.array(scores, pa.float64()), pa.array(first, pa.int32())]
            yield pa.record_batch([batch.column("block"), batch.column("island"), batch.column("lengths"), *made], names=["block", "island", "lengths", "packings", "score", "start_bins"])

    return work


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces (lengths 1 to capacity); each sequence is gapless from 0.

    crossovers counts those made for a piece's block on all islands, bins_saved the sequences by which they bettered
    plain best fit decreasing of that block; both are 0 for pieces that fill a sequence.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    none = {"crossovers": F.lit(0), "bins_saved": F.lit(0)}
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), **none})
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    grouped = materialize(dealt.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("pieces")), "blocks")

    state = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("pieces.length").alias("lengths"))
    state = state.withColumns({"packings": F.lit(None).cast("array<array<int>>"), "guest": F.lit(None).cast("array<int>"), "start_bins": F.lit(None).cast("int")})
    spread = max(spark.sparkContext.defaultParallelism, min(blocks * ISLANDS, 10_000))
    evolved = None
    for epoch in range(EPOCHS):
        last, kind = evolved, "block long, island int, lengths array<long>, packings array<array<int>>, score double, start_bins int"
        evolved = materialize(state.repartition(spread, "block", "island").mapInArrow(_evolution(capacity, epoch), kind), "islands")
        if last is not None:
            drop_scratch(last)
        elite = evolved.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.element_at("packings", 1).alias("guest"))
        state = evolved.drop("score").join(elite, ["block", "island"])
    best = evolved.groupBy("block").agg(F.max_by(F.element_at("packings", 1), F.struct("score", -F.col("island"))).alias("bins"), F.min("start_bins").alias("start_bins"))
    best = best.select("block", "bins", (F.col("start_bins") - F.array_max("bins") - 1).alias("bins_saved"))

    item = F.explode(F.arrays_zip("pieces", "bins")).alias("x")
    placed = grouped.join(best, "block").select("block", "bins_saved", item).select("block", "bins_saved", *[F.col(f"x.pieces.{c}").alias(c) for c in columns], F.col("x.bins").alias("bin"))
    by_bin = placed.groupBy("block", "bin").agg(F.collect_list(F.struct(*columns)).alias("items"), F.first("bins_saved").alias("bins_saved"))
    ends = F.aggregate("items", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["length"])))
    laid = by_bin.withColumn("starts", F.slice(ends, F.lit(1), F.size("items"))).select("block", "bin", "bins_saved", F.explode(F.arrays_zip("items", "starts")).alias("x"))
    place = (F.col("block") * (1 << 32) + F.col("bin")).alias("sequence_id"), F.col("x.starts").alias("offset")
    laid = laid.select(*[F.col(f"x.items.{c}").alias(c) for c in columns], *place, F.lit(ISLANDS * EPOCHS * GENERATIONS).alias("crossovers"), "bins_saved")
    return full.unionByName(laid)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, crossovers, bins_saved per piece of every row of docs.

    Null and empty texts are one piece that holds id 0. Rows with null or repeated ids are packed each; extra columns are
    dropped; empty docs give an empty result.
    """
    return pack(materialize(tokenize(docs, capacity), "pieces"), capacity)
