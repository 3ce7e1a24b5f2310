"""Benchmark decontamination by greedy string tiling.

Words (ASCII letters and digits, and all beyond ASCII; case folded) of texts and items meet in seeds: windows of
`min_match` words with equal hashes. Seeds in a row form maximal matches; the longest are marked first, and what is left
of a match between marked words counts again, until no match of `min_match` unmarked words remains. An item is leaked
into a text where the tiles cover at least `coverage` of its words, in whatever order they stand; an item of fewer than
`min_match` words where all its words stand in a row.

Equal seeds are not paired before the distinct ones say that they could cover enough; then pairs of seeds are made some
at a time and joined to matches at once, so that a text of one word over and over takes no more memory than another.

Items are taken in blocks of at most BLOCK_BYTES, each broadcast, against all texts where they lie: nothing is shuffled,
so an item that a third of all texts hold makes no large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_defaults
from .tokens import ALNUM, U, byte_values, tokens, windows

#: Words of the shortest match, and the share of an item's words that tiles must cover.
MIN_MATCH, COVERAGE = 5, 0.5

#: Text of the items that are broadcast at once.
BLOCK_BYTES = 8 << 20

_VALUES = byte_values(fold_case=True)


class Seeds(NamedTuple):
    """Windows of one item in ascending order of hash, then place, and their places in it."""

    seed: np.ndarray
    place: np.ndarray


class Items(NamedTuple):
    """Items of one block and one seed length: ids, bounds, and all seeds in ascending order with their places; a bitmap of them."""

    ids: list
    bounds: np.ndarray
    grams: np.ndarray
    seed: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    min_match: int

    def seeds_of(self, k: int) -> Seeds:
        own = self.grams[self.bounds[k] : self.bounds[k + 1] - self.min_match + 1]
        order = np.argsort(own, kind="stable")
        return Seeds(own[order], order)


_BITS = 20


def _items(rows: list, min_match: int) -> list[Items]:
    """Items by the length of their seeds: min_match, or the whole item where it is shorter."""
    chunks = list(tokens(pa.array([r["text"] for r in rows], pa.string()), ALNUM, _VALUES))
    hashes = np.concatenate([c.hash for c in chunks]) if chunks else np.zeros(0, np.uint64)
    sizes = np.array([n for c in chunks for n in np.diff(c.bounds)], np.int64)
    owner, out = np.repeat(np.arange(len(sizes)), sizes), []
    for length in range(1, min_match + 1):
        mine = sizes >= length if length == min_match else sizes == length
        if not mine.any():
            continue
        bounds = np.append(0, np.cumsum(sizes[mine]))
        grams = windows(hashes[mine[owner]], length)
        place = np.flatnonzero(np.arange(len(grams)) + length <= np.repeat(bounds[1:], np.diff(bounds))[: len(grams)])
        place = place[np.argsort(grams[place], kind="stable")]
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[grams[place] >> U(64 - _BITS)] = True
        out.append(Items([rows[k]["item_id"] for k in np.flatnonzero(mine)], bounds, grams, grams[place], place, bitmap, length))
    return out


#: Pairs of seeds that are made at once.
PAIRS = 1 << 18


def matches(text: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text place, item place, words) of the maximal matches. Seed k stands at text[k] (ascending) and at place[low[k]:high[k]]."""
    stops = np.cumsum(high - low)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_diagonal = open_first = open_next = np.zeros(0, np.int64)  # matches that may go on, by ascending diagonal
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + PAIRS, "right")))
        n = high[a:b] - low[a:b]
        at = np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
        t = np.repeat(text[a:b], n)
        diagonal = t - place[at]
        order = np.argsort(diagonal, kind="stable")
        diagonal, t = diagonal[order], t[order]
        new = np.ones(len(t), bool)
        new[1:] = (diagonal[1:] != diagonal[:-1]) | (t[1:] != t[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(t)) - 1
        diagonal, begin, after = diagonal[first], t[first], t[last] + 1
        # the first match of a diagonal goes on with the one that is open there
        k = np.searchsorted(diagonal, open_diagonal).clip(max=max(len(diagonal) - 1, 0))
        goes_on = (diagonal[k] == open_diagonal) & (begin[k] == open_next) if len(diagonal) else np.zeros(len(k), bool)
        begin[k[goes_on]] = open_first[goes_on]
        edge = int(text[b - 1]) + 1
        rest = ~goes_on
        found.append((open_diagonal[rest], open_first[rest], open_next[rest]))
        done = after < edge
        found.append((diagonal[done], begin[done], after[done]))
        open_diagonal, open_first, open_next = diagonal[~done], begin[~done], after[~done]
        a = b
    found.append((open_diagonal, open_first, open_next))
    diagonal, begin, after = (np.concatenate(x) for x in zip(*found, strict=True))
    return begin, begin - diagonal, after - begin + min_match - 1


def tiles(found: tuple[np.ndarray, np.ndarray, np.ndarray], min_match: int, n_text: int, n_item: int) -> list[tuple[int, int, int]]:
    """(text place, item place, words) of greedy tiles: longest first, of equals the earliest in the text, then in the item."""
    heap = [(-n, t, i) for t, i, n in zip(*(x.tolist() for x in found), strict=True)]
    heapify(heap)
    taken_text, taken_item, out, left = np.zeros(n_text, bool), np.zeros(n_item, bool), [], n_item
    while heap and left >= min_match:
        n, t, i = heappop(heap)
        free = ~(taken_text[t : t - n] | taken_item[i : i - n])
        if free.all():
            taken_text[t : t - n] = taken_item[i : i - n] = True
            out.append((t, i, -n))
            left += n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a >= min_match:
                heappush(heap, (a - b, t + a, i + a))
    return out


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of every place of the ranges low:high."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _leaks(chunk, items: Items, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(document, item, tiles) of the leaks in one chunk of documents."""
    min_match = items.min_match
    grams = windows(chunk.hash, min_match)
    hits = np.flatnonzero(items.bitmap[grams >> U(64 - _BITS)])
    hits = hits[hits + min_match <= chunk.ends[hits]]
    low, high = np.searchsorted(items.seed, grams[hits], "left"), np.searchsorted(items.seed, grams[hits], "right")
    some = low < high
    hits, low, high = hits[some], low[some], high[some]
    if not len(hits):
        return
    owner = chunk.owner[hits]
    for docs in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(owner)) + 1):
        d = int(owner[docs[0]])
        begin, size_text = int(chunk.bounds[d]), int(chunk.bounds[d + 1] - chunk.bounds[d])
        # each distinct seed once: which places of which items it holds
        seeds, first = np.unique(low[docs], return_index=True)
        place = np.sort(items.place[_spread(seeds, high[docs][first])[1]])
        item = np.searchsorted(items.bounds, place, "right") - 1
        for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(item)) + 1):
            k = int(item[part[0]])
            start, size = int(items.bounds[k]), int(items.bounds[k + 1] - items.bounds[k])
            seen = place[part] - start
            reach = min_match + np.minimum(np.diff(seen), min_match).sum()  # no tiling can cover more than all seeds do
            if reach < coverage * size:
                continue
            # seeds are in order of hash, then place: those of this item are a range of each hash's places
            own = items.seeds_of(k)
            a, b = np.searchsorted(own.seed, grams[hits[docs]], "left"), np.searchsorted(own.seed, grams[hits[docs]], "right")
            held = a < b
            found = tiles(matches(hits[docs][held] - begin, a[held], b[held], own.place, min_match), min_match, size_text, size)
            if sum(t[2] for t in found) >= coverage * size:
                yield d, k, found


def _pairs(column: pa.Array, blocks: list[Items]) -> Iterator[tuple]:
    for chunk in tokens(column, ALNUM, _VALUES):
        for items in blocks:
            yield chunk, items


_LEAK = "doc_id long, item_id long, n_tokens long, n_covered long, coverage double, tiles array<struct<text_word: long, item_word: long, words: long>>"


def _blocks(benchmark: DataFrame, min_match: int) -> Iterator:
    """Broadcast items, BLOCK_BYTES of text at a time."""
    asked = with_defaults(benchmark, item_id="long", text="string").where(F.col("text").isNotNull())
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(_items(rows, min_match))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """A row for each text and item that is leaked into it: doc_id, item_id, n_tokens (of the item), n_covered, coverage, tiles.

    Null and empty texts and items take no part, nor do items without words. Items of fewer than min_match words must stand
    whole. Rows with null or repeated
    ids are judged each. Extra columns are ignored. An empty table on either side gives an empty result.
    """
    texts, found = with_defaults(docs, doc_id="long", text="string"), docs.sparkSession.createDataFrame([], _LEAK)
    for shared in _blocks(benchmark, min_match):

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = []
                for chunk, items in _pairs(batch.column(1), shared.value):
                    for d, i, found in _leaks(chunk, items, coverage):
                        size, covered = int(items.bounds[i + 1] - items.bounds[i]), sum(t[2] for t in found)
                        rows.append((batch.column(0)[chunk.first + d].as_py(), items.ids[i], size, covered, covered / size, [{"text_word": t, "item_word": p, "words": n} for t, p, n in sorted(found)]))
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)

        found = found.unionByName(texts.mapInArrow(work, _LEAK))
    return found


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int64()), ("n_covered", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([(n, pa.int64()) for n in ("text_word", "item_word", "words")])))])


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_tokens, n_covered, coverage, n_tiles of the leaks."""
    return benchmark_leaks(docs, benchmark).select("doc_id", "item_id", "n_tokens", "n_covered", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs into which no item is leaked, with all their columns. Each row is judged where it lies; nothing is shuffled."""
    at, schema = docs.columns.index("text"), docs.schema
    for shared in _blocks(benchmark, min_match):

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                for chunk, items in _pairs(batch.column(at), shared.value):
                    for d, _, _ in _leaks(chunk, items, coverage):
                        clean[chunk.first + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(work, schema)
    return docs
