"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A text's signature has SYMBOLS numbers of 8 bits, each from the least of its shingles' hashes under one function; two texts of Jaccard
similarity J differ in a share (1 - J)(1 - 1/256) of the symbols on average. Signatures that differ in MAX_DISTANCE symbols at most are
candidates, and the join finds all of them: dealt into CHUNKS chunks, such a pair has by the pigeonhole principle a chunk with ERRORS = 1
differing symbol at most, so it agrees in one of the chunk's patterns that leave one symbol out. Those patterns are the join keys, one for each
symbol. At J = 0.8 a pair lies within the distance with probability 0.9996, at 0.85 with 0.99999; candidates are then held
against each other by their whole shingle sets, so that what is linked is exact.

Only components are asked for, so pairs are never listed. One member leads each key and those that are candidates with it are held against it,
which joins most copies. Keys all of whose members are in one component are done. In the others, members outside of the leader's component
are compared by their signatures with all that are not in their own, in blocks of bounded size that return a spanning forest; that gives groups of
components with candidates between them. Within a group whole sets are compared in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, slices, with_defaults
from .graph import connected_components
from .near import _joined as joined
from .near import linked
from .tokens import WORDS, U, byte_values, mix, tokens, windows

#: Symbols of a signature, chunks on which keys are made, differing symbols that a chunk may have.
SYMBOLS, CHUNKS, ERRORS = 64, 12, 1

#: Pigeonhole: of so many differing symbols, some chunk has ERRORS at most.
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1

#: Members of a key of which signatures, and of a group of which sets, are compared at once.
KEY_BLOCK, BLOCK = 1024, 256

_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_PLACES = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_EDGES = [SYMBOLS * i // CHUNKS for i in range(CHUNKS + 1)]


def shingle_sets(column: pa.Array, k: int = 2) -> Iterator[np.ndarray]:
    """For each text the ascending distinct hashes of its runs of k words, A-Z lower-cased; of all words where there are fewer."""
    for chunk in tokens(column, WORDS, byte_values(True)):
        grams = windows(chunk.hash, k)
        for a, b in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - k + 1]) if b - a >= k else windows(chunk.hash[a:b], max(b - a, 1))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS bytes for each set; none of them may be empty."""
    out = np.empty((len(sets), SYMBOLS), np.uint64)
    if sets:
        every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        for i, factor in enumerate(_FACTORS):
            out[:, i] = np.minimum.reduceat(every * factor, starts)
    return mix(out).astype(np.uint8)


def patterns(prints: np.ndarray) -> np.ndarray:
    """A key for each signature and symbol: the other symbols of its chunk."""
    each = mix(prints.astype(np.uint64) + _PLACES)
    keys = np.empty_like(each)
    for a, b in zip(_EDGES, _EDGES[1:], strict=False):
        keys[:, a:b] = each[:, a:b].sum(axis=1, dtype=np.uint64)[:, None] - each[:, a:b]
    return mix(keys + _PLACES)


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SYMBOLS)


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, key, text_hash, n, digest, print) for each row: the set's size, a 128-bit digest of it, its signature; both null where it is empty.

    key is the id, or for a row without one a number above 2^62 made from its text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, counts, prints, held, size = [], [], [], [], 0
            for own in shingle_sets(batch.column(3), shingle):
                counts.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                if len(own):
                    held.append(own)
                    size += len(own)
                if size > 1 << 17:
                    prints += [p.tobytes() for p in signatures(held)]
                    held, size = [], 0
            found = iter(prints + [p.tobytes() for p in signatures(held)])
            columns = [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array([next(found) if n else None for n in counts], pa.binary())]
            yield pa.record_batch(columns, names=["id", "key", "text_hash", "n", "digest", "print"])

    rows = with_defaults(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    key = F.coalesce("doc_id", F.shiftrightunsigned("text_hash", 2).bitwiseOR(F.lit(1 << 62)))
    return rows.select(F.col("doc_id").alias("id"), key.alias("key"), "text_hash", "text").mapInArrow(work, "id long, key long, text_hash long, n long, digest binary, print binary")


def _members(classes: DataFrame) -> DataFrame:
    """(key, c): the keys that several classes have, with those classes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = patterns(_prints(batch.column(1)))
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), SYMBOLS))], names=["key", "c"])

    rows = classes.select("c", "print").mapInArrow(keyed, "key long, c long")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return rows.join(shared, "key")


def _sets(docs: DataFrame, classes: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(c, held): the whole shingle set of each class in members, made anew from one of its texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), shingle)], pa.binary())], names=["c", "held"])

    named = classes.join(members.select("c").distinct(), "c").select("c", "key", "text_hash")
    texts = with_defaults(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    texts = texts.withColumn("key", F.coalesce("doc_id", F.shiftrightunsigned("text_hash", 2).bitwiseOR(F.lit(1 << 62))))
    return texts.join(named, ["key", "text_hash"]).select("c", "text").mapInArrow(work, "c long, held binary").dropDuplicates(["c"])


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column's value of both."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("c").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs whose signatures lie within MAX_DISTANCE."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            near = (_prints(batch.column(2)) != _prints(batch.column(3))).sum(axis=1) <= MAX_DISTANCE
            yield pa.record_batch([c.filter(pa.array(near)) for c in batch.columns[:2]], names=["a", "b"])

    return _with_both(pairs, classes, "print").mapInArrow(work, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose whole sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            near = [bool(linked([np.frombuffer(a.as_py(), np.uint64)], [np.frombuffer(b.as_py(), np.uint64)], percent / 100)[0, 0]) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return _with_both(pairs, sets, "held").mapInArrow(work, "a long, b long")


def _across(rows: DataFrame, by: str, payload: str, size: int, close: Callable[[list[bytes], list[bytes]], np.ndarray]) -> DataFrame:
    """Distinct (a, b): components to be joined, as some of their members of one `by` are close.

    rows has by, c, root and payload. Members stay in a block of their own; those outside of the component that most are in
    go through every block as well, in turns. A block and a turn, of `size` rows or so, give a spanning forest of the components that meet in them.
    """
    sizes = rows.groupBy(by, "root").agg(F.count("*").alias("n"))
    counts = sizes.groupBy(by).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).withColumn("open", F.col("n") - F.col("most.n")).where("open > 0")
    blocks_of = lambda n: F.ceil(F.col(n) / size).cast("int")
    counts = materialize(counts.select(by, F.col("most.root").alias("lead_root"), blocks_of("n").alias("blocks"), blocks_of("open").alias("turns")), "counts")
    dealt = rows.join(counts, by)
    dealt = dealt.withColumns({k: F.pmod(F.xxhash64("c", F.lit(i)), F.col(f"{k}s").cast("long")).cast("int") for i, k in enumerate(("block", "turn"))})
    stays = F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda x: F.struct(F.col("block"), x.alias("turn"), F.lit(False).alias("goes")))
    goes = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("block"), F.col("turn"), F.lit(True).alias("goes")))
    dealt = dealt.withColumn("x", F.explode(F.when(F.col("root") != F.col("lead_root"), F.concat(stays, goes)).otherwise(stays)))
    dealt = dealt.select(by, F.col("x.block").alias("block"), F.col("x.turn").alias("turn"), F.col("x.goes").alias("goes"), "root", payload)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stay, go = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if stay and go:
                nodes, of = np.unique(np.array([r for r, _ in stay] + [r for r, _ in go]), return_inverse=True)
                i, j = np.nonzero(close([p for _, p in go], [p for _, p in stay]) & (of[len(stay) :, None] != of[None, : len(stay)]))
                label = joined(np.arange(len(nodes)), of[len(stay) + i], of[j])
                member = np.flatnonzero(label != np.arange(len(nodes)))
                yield pa.record_batch([pa.array(nodes[label[member]]), pa.array(nodes[member])], names=["a", "b"])
            go.clear()

        for batch in slices(batches, size):
            for place, block, turn, goes, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (place, block, turn) != now:
                    yield from flush()
                    stay.clear()
                    now = place, block, turn
                (go if goes else stay).append(own)
                if len(go) == size:
                    yield from flush()
        yield from flush()

    group = [by, "block", "turn"]
    return dealt.repartition(*group).sortWithinPartitions(*group, "goes").mapInArrow(work, "a long, b long").distinct()


def _prints_close(left: list[bytes], right: list[bytes]) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, SYMBOLS) for x in (left, right))
    return np.stack([(x != b).sum(axis=1) <= MAX_DISTANCE for x in a])


def class_links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, root) of the classes that links connect with others; classes has c, key, text_hash and print."""
    members = materialize(_members(classes), "members", hashes=True)
    sets = materialize(_sets(docs, classes, members, shingle), "sets", hashes=True)
    leads = members.groupBy("key").agg(F.min_by("c", F.xxhash64("c")).alias("a"))
    pairs = members.join(leads, "key").where("a != c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
    links = materialize(_confirmed(materialize(_close(pairs, classes), "close", hashes=True), sets, percent), "links", hashes=True)

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))

    now = materialize(rooted(members, connected_components(links)), "rooted", hashes=True)
    unlike = materialize(now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "unlike", hashes=True)
    open_rows = materialize(now.join(unlike, "key").join(classes.select("c", "print"), "c"), "open", hashes=True)
    groups = connected_components(_across(open_rows, "key", "print", KEY_BLOCK, _prints_close))
    # every pair in question has both its members in open rows of one key
    grouped = open_rows.select("c", "root").distinct().join(groups.select(F.col("node").alias("root"), F.col("root").alias("group")), "root").join(sets, "c")

    def similar(left: list[bytes], right: list[bytes]) -> np.ndarray:
        return linked(*([np.frombuffer(x, np.uint64) for x in side] for side in (left, right)), percent / 100)

    more = materialize(_across(materialize(grouped, "grouped", hashes=True), "group", "held", BLOCK, similar), "more", hashes=True)
    roots = connected_components(links.unionByName(more))
    for x in (members, sets, now, open_rows):
        drop_scratch(x)
    return roots


def minhash_components(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """(id, n, component) for each row of doc_id and text: its set's size, and the smallest id that links reach, the own one included.

    Links join texts whose sets of distinct runs of `shingle` words have a Jaccard similarity of percent / 100 or more. A text of fewer words is
    one run; one without words, or null, has an empty set and is linked with nothing. Rows without an id take part in links and name no
    component unless it has no other id (then null). Repeated rows stay repeated, unlike texts of one id are linked each by its own text.
    Empty input gives an empty result; other columns are ignored.
    """
    rows = materialize(signed(docs, shingle), "signed", hashes=True)
    some = rows.where("n > 0").groupBy("digest", "print").agg(F.min("key").alias("key"), F.min_by("text_hash", "key").alias("text_hash"), F.min("id").alias("first"))
    # numbered as they are written: what is read again has the same numbers
    classes = materialize(some.withColumn("c", F.monotonically_increasing_id()), "classes", hashes=True)
    roots = class_links(docs, classes, shingle, percent)
    rooted = materialize(classes.select("c", "digest", "first").join(roots.withColumnRenamed("node", "c"), "c", "left").select("digest", "first", F.coalesce("root", "c").alias("root")), "rooted", hashes=True)
    # written first: a join of two bare scans is dealt anew where one component has many classes
    lowest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component")), "lowest", hashes=True)
    named = materialize(rooted.join(lowest, "root").select("digest", "component"), "named", hashes=True)
    return rows.where("n > 0").join(named, "digest").select("id", "n", "component").unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))


def near_duplicate_report(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the id names its component) for each row of docs; see minhash_components()."""
    found = minhash_components(docs, shingle, percent)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
