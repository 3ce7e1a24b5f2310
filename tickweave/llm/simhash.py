"""SimHash near-duplicates with a pigeonring filter.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Fingerprints at
most `tau` bits apart are linked. The 64 bits are dealt into m = tau + 1 segments on a ring. By the
pigeonring principle a linked pair has a segment i such that every chain i, i+1, ..., i+l-1 differs in at
most l * tau / m bits, which is l - 1 for l <= tau. So segment i is equal and the next differs in one bit at
most, hence has an equal half: segment and half form the join key. The longer chains prune pairs
before the full Hamming distance is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, materialize, with_defaults
from .graph import connected_components
from .near import keep_one_of_each  # noqa: F401

#: Fingerprints of one key that are compared at once; fuller keys are dealt into blocks of about this size.
BLOCK = 512

_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash; 0 where there are no words (null and blank texts too)."""
    words = re.findall(WORD_BYTES, (text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    k = min(shingle, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), stops[k - 1 :].tolist(), strict=True))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), _CHUNK):
        part = np.array([digest(joined[a:b], 42) for a, b in spans[at : at + _CHUNK]], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): one row per row of docs, repeated rows and null ids included; other columns are ignored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(work, "id long, fp long")


def _segments(tau: int) -> list[tuple[int, int]]:
    """(shift, width) of each of tau + 1 segments of 64 bits."""
    m = tau + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(fp: F.Column, shift: int, width: int) -> F.Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(fp: F.Column, tau: int) -> F.Column:
    """The keys of a fingerprint: (segment number and half, equal bits) as structs."""
    segments, keys = _segments(tau), []
    if tau == 0:
        return F.array(F.struct(F.lit(0).alias("kind"), fp.alias("bits")))
    for i, (shift, width) in enumerate(segments):
        after, more = segments[(i + 1) % len(segments)]
        for half, (at, bits) in enumerate(((after, more // 2), (after + more // 2, more - more // 2))):
            keys.append(F.struct(F.lit(2 * i + half).alias("kind"), F.shiftleft(_part(fp, shift, width), bits).bitwiseOR(_part(fp, at, bits)).alias("bits")))
    return F.array(*keys)


def _linked(prints: np.ndarray, kind: int, tau: int) -> np.ndarray:
    """Boolean matrix of pairs that pass the chains from segment kind // 2 on, then the full distance."""
    segments, m = _segments(tau), tau + 1
    a, b = np.triu_indices(len(prints), 1)
    x, spent = prints[a] ^ prints[b], np.zeros(len(a), np.int64)
    for length in range(1, m):
        shift, width = segments[(kind // 2 + length - 1) % m]
        spent += np.bitwise_count((x >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        keep = spent <= length * tau // m
        a, b, x, spent = a[keep], b[keep], x[keep], spent[keep]
    keep = np.bitwise_count(x) <= tau
    out = np.zeros((len(prints), len(prints)), bool)
    out[a[keep], b[keep]] = out[b[keep], a[keep]] = True
    return out


def _stars(prints: np.ndarray, kind: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning star for each component within these fingerprints: one per member at most."""
    linked, n = _linked(prints, kind, tau), len(prints)
    np.fill_diagonal(linked, True)
    root = np.arange(n)
    while True:
        after = np.where(linked, root[None, :], n).min(axis=1)
        if (after == root).all():
            break
        root = after
    member = np.flatnonzero(root != np.arange(n))
    return prints[root[member]], prints[member]


def fingerprint_links(prints: DataFrame, tau: int = 3) -> DataFrame:
    """Distinct fp -> (a, b) edges that connect exactly the fingerprints that links of at most tau bits connect.

    A key that holds more than BLOCK fingerprints is dealt into blocks, each pair of blocks is a group of its own,
    and a group returns a spanning star for each component in it, so hot keys yield neither large groups nor all pairs.
    """
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), tau)).alias("key")).select("fp", "key.kind", "key.bits")
    many = keyed.groupBy("kind", "bits").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    dealt = keyed.join(many, ["kind", "bits"]).withColumn("own", own).select("fp", "kind", "bits", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("fp", "kind", "bits", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
    group = ["kind", "bits", "left", "right"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def edges(rows: np.ndarray, last: bool) -> tuple[list, np.ndarray]:
            cuts = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)) + 1
            parts = np.split(rows, cuts)
            done, rest = (parts, rows[:0]) if last else (parts[:-1], parts[-1])
            return [_stars(p[:, 0].astype(np.int64).view(np.uint64), int(p[0, 1]), tau) for p in done if len(p) > 1], rest

        def out(found: list) -> pa.RecordBatch:
            sides = [np.concatenate([f[i] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1)]
            return pa.record_batch([pa.array(s) for s in sides], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = rows if held is None else np.concatenate([held, rows])
            if len(rows):
                found, held = edges(rows, False)
                yield out(found)
        if held is not None and len(held):
            yield out(edges(held, True)[0])

    return dealt.repartition(*group).sortWithinPartitions(*group, "fp").select("fp", *group).mapInArrow(work, "a long, b long").where("a != b").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id that links of at most tau bits reach, the own one included.

    Null and blank texts have fingerprint 0 and link like any other. Rows with a null id are kept, take part in
    linking, and never name a component unless it has no other id (then null). Repeated rows stay repeated.
    Empty input gives an empty result; extra columns are ignored.
    """
    rows = materialize(simhash_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(fingerprint_links(classes.select("fp"), tau))
    rooted = materialize(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(lowest, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def near_duplicate_classes(docs: DataFrame, shingle: int = 3, tau: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id per row of docs (see simhash_components)."""
    found = simhash_components(with_defaults(docs, doc_id="long", text="string"), shingle=shingle, tau=tau)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
