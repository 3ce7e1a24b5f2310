"""Periodic runs of words: stretches that repeat a block of words at least four times over.

Each text's words are named by Karp, Miller and Rosenberg's scheme: the names of level k tell blocks of 2^k words apart, and
come from ranking pairs of names of level k - 1. Two words of a stretch with period q and length 4q stand at each place of it,
q apart, and agree for 3q places; so at some multiple of 2q the blocks of 2^k <= q words there and q further on have one name.
Only those grid places are candidates. How far each agrees ahead and behind (the longest common extension) is read off the names,
from the highest level down, which gives the run's ends. No names are made beyond the level at which no two blocks are equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, slices, with_defaults

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

#: Candidates extended at once.
_CHUNK = 1 << 18


class Runs(NamedTuple):
    """start, length and period of each run, by start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def names(words: np.ndarray, top: int) -> list[np.ndarray]:
    """Levels 0 to top of names; fewer if no two blocks of a level are equal, as no longer ones are then."""
    levels = [words.astype(np.int32)]
    while len(levels) <= top and len(levels[-1]) > 1 << (len(levels) - 1):
        below, half = levels[-1], 1 << (len(levels) - 1)
        pairs = below[:-half].astype(np.int64) * (int(below.max()) + 1) + below[half:]
        known, own = np.unique(pairs, return_inverse=True)
        if len(known) == len(pairs):
            break
        levels.append(own.reshape(-1).astype(np.int32))
    return levels


def _ahead(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words agree from places left and right (the greater) on."""
    found = np.zeros(len(left), np.int64)
    # blocks of the highest level may follow each other any number of times, those below once
    for k in range(len(levels) - 1, -1, -1):
        name, open_ = levels[k], np.arange(len(left))
        while len(open_):
            at = right[open_] + found[open_]
            open_, at = open_[at < len(name)], at[at < len(name)]
            open_ = open_[name[at] == name[left[open_] + found[open_]]]
            found[open_] += 1 << k
            if k < len(levels) - 1:
                break
    return found


def _behind(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words agree before places left and right (the greater)."""
    found = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, open_ = levels[k], np.arange(len(left))
        while len(open_):
            at = left[open_] - found[open_] - (1 << k)
            open_, at = open_[at >= 0], at[at >= 0]
            open_ = open_[name[at] == name[at + right[open_] - left[open_]]]
            found[open_] += 1 << k
            if k < len(levels) - 1:
                break
    return found


def _grid(name: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of candidates with a period from low to below high, at multiples of twice the period, some at a time."""
    held, many = [], 0
    for q in range(low, high):
        place = np.arange(0, len(name) - q, 2 * q)
        place = place[name[place] == name[place + q]]
        if len(place):
            held.append((place, np.full(len(place), q)))
            many += len(place)
        if many >= _CHUNK:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, many = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def find_runs(words: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> Runs:
    """All runs of words given as numbers below their count; periods is 4 or more (the grid relies on it)."""
    if periods < 4:
        raise ValueError("the grid finds runs of four periods or more")
    n, best = len(words), {}
    levels = names(words, max(n // periods, 1).bit_length())
    for k, name in enumerate(levels):
        if len(name) == 0 or 1 << k > n // periods:
            break
        for place, q in _grid(name, 1 << k, min(2 << k, n // periods + 1)):
            for at in range(0, len(place), _CHUNK):
                i, p = place[at : at + _CHUNK], q[at : at + _CHUNK]
                back = _behind(levels, i, i + p)
                length = back + _ahead(levels, i, i + p) + p
                full = length >= np.maximum(least, periods * p)
                found = np.unique(np.stack([(i - back)[full], length[full], p[full]], axis=1), axis=0)
                for start, size, period in found.tolist():
                    # a stretch with a smaller period has all its multiples too, and the same ends for each
                    best[start, size] = min(period, best.get((start, size), period))
    out = np.array(sorted((s, p, n) for (s, n), p in best.items()), np.int64).reshape(-1, 3)
    return Runs(out[:, 0], out[:, 2], out[:, 1])


def kept_words(n: int, runs: Runs) -> np.ndarray:
    """Which words stay if of every run only the first period does; a word goes if any run says so."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:-1]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy() if words else np.zeros(0, np.int32)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) for each row: runs as (start, length, period) by start and period; collapsed is the text's words
    joined by single spaces, without those that a run has after its first period.

    A null or blank text has no words, no runs and an empty collapsed text. Null ids and repeated rows stay; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            counts, runs, collapsed = [], [], []
            for text in batch.column(1):
                words = re.findall(WORD_BYTES, (text.as_py() or "").encode("utf-8", "surrogatepass"))
                found = find_runs(numbered(words))
                if len(found.start):
                    words_left = [w for w, x in zip(words, kept_words(len(words), found).tolist(), strict=True) if x]
                counts.append(len(words))
                runs.append([dict(zip(Runs._fields, r, strict=True)) for r in zip(*(x.tolist() for x in found), strict=True)])
                collapsed.append(b" ".join(words_left if len(found.start) else words).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(work, "id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text), a tenth of the texts made periodic from some word on, as the crc32 of the id says; the others are left alone.

    With h = crc32(id), g = h // 10: where h % 10 = 0, word i >= a becomes word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) // (3 + g % 8). A row without an id is left alone.
    """
    rows = with_defaults(docs, doc_id="long", text="string")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumns({"_g": F.floor(h / 10), "_words": F.when(h % 10 == 0, words)}).withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))

    def periodic(word: Column, i: Column) -> Column:
        return F.when(i < F.col("_a"), word).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))

    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(F.transform("_words", periodic), " ")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli (null without runs), and SHA-256 of all runs and of the collapsed text.

    Of runs of one length the one with the smallest start, then period, is named. A row for each row of docs (see periodic_runs()).
    """
    found = periodic_runs(with_planted_periods(docs))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.withColumn("_best", best)
    length = -F.col("_best.less")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(1000 * length / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
