"""SimHash near copies at a Jaccard similarity, for a corpus of which one of each group is to stay.

Texts of similarity 0.8 over word shingles have SimHash fingerprints that differ in 15 % of their bits, whatever their
number, too many for the few wide segments that serve links of 3 bits. So this fingerprint has 1024 bits, a ring of 64
segments. Its join keys are the segments themselves: one that is equal starts a chain, and the pair is a candidate if the
CHAIN segments that follow it on the ring keep, one after the other, within BUDGET differing bits a segment on average
(pigeonring). A chain of unlike texts holds with a probability of 3e-9, one of a pair at 0.8 nearly always. Such a pair
has an equal segment with probability 0.99 (1 - (1 - 0.85^16)^64; 0.9999 at 0.85). Candidates are then held against
each other by their whole shingle sets, so what is linked is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, drop_scratch, materialize, slices
from .graph import connected_components
from .tokens import U, mix

#: Segments of 16 bits on the ring, segments of a chain behind its first, differing bits allowed for each segment of a chain.
SEGMENTS, CHAIN, BUDGET = 64, 8, 3.5

#: Fingerprints of one key, and sets of one group, that are compared at once; more are dealt into blocks of about this size.
KEY_BLOCK, BLOCK = 512, 256

#: A key is a segment's number and its bits.
_KEY_BITS = 16 + SEGMENTS.bit_length() - 1

_WORDS = np.arange(1, SEGMENTS // 4 + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
_SPENT = np.floor(BUDGET * np.arange(2, CHAIN + 2))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the runs of k words (of all words where there are fewer); one 0 for a text without words."""
    words = re.findall(WORD_BYTES, (text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(1, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), stops[k - 1 :].tolist(), strict=True)], dtype=np.uint64))


def fingerprint(have: np.ndarray) -> np.ndarray:
    """SEGMENTS numbers of 16 bits: for each bit, whether more than half of the shingles have it in hashes made from theirs."""
    ones = np.zeros(16 * SEGMENTS, np.int64)
    for at in range(0, len(have), 255):  # so many fit a byte
        hashes = mix(have[at : at + 255, None] + _WORDS)
        ones += np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(have)).view(np.uint16)


def ring(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, chains): a key for each fingerprint and segment, and the CHAIN segments behind it as two 64-bit words."""
    keys = prints.astype(np.int64) + (np.arange(SEGMENTS, dtype=np.int64) << 16)
    around = np.concatenate([prints, prints[:, :CHAIN]], axis=1)
    behind = np.lib.stride_tricks.sliding_window_view(around[:, 1:], CHAIN, axis=1)
    return keys.reshape(-1), np.ascontiguousarray(behind).view(np.int64).reshape(-1, CHAIN // 4)


def chained(x: np.ndarray) -> np.ndarray:
    """Which differences (two 64-bit words each) keep every chain within its budget."""
    able = np.flatnonzero(np.bitwise_count(x[:, 0]) <= _SPENT[3])
    spent = np.cumsum(np.bitwise_count(np.ascontiguousarray(x[able]).view(np.uint16)), axis=1)
    return able[(spent <= _SPENT).all(axis=1)]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the pairs a, b are joined too: the least label that each place reaches."""
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], least)
        np.minimum.at(after, root[b], least)
        after = after[after[root]]
        if (after == root).all():
            return root
        root = after


def _key_edges(groups: np.ndarray, t: np.ndarray, chains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each group (rows in a row), what chains connect: one for each row at most."""
    n = len(t)
    ends = np.append(np.flatnonzero(groups[1:] != groups[:-1]) + 1, n)
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    root, place, step = np.arange(n), np.arange(n), 1
    while len(place := place[place + step < end[place]]):
        pair = place[root[place] != root[place + step]]
        found = pair[chained(chains[pair] ^ chains[pair + step])]
        if len(found):
            root = _joined(root, found, found + step)
        step += 1
    member = np.flatnonzero(root != np.arange(n))
    return t[root[member]], t[member]


def _candidates(texts: DataFrame, k: int) -> DataFrame:
    """Distinct (t, root): texts, by their hash, that chains connect; texts without candidates are left out."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(shingles(x.as_py(), k)).tobytes() for x in batch.column(1)], pa.binary())], names=["t", "print"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, chains = ring(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SEGMENTS))
            t = np.repeat(batch.column(0).to_numpy(), SEGMENTS)
            yield pa.record_batch([pa.array(x) for x in (t, keys, chains[:, 0], chains[:, 1])], names=["t", "key", "near", "far"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(ring(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SEGMENTS))[0], return_counts=True)
            yield pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "n"])

    once = materialize(texts.mapInArrow(prints, "t long, print binary").dropDuplicates(["t"]), "prints", hashes=True)
    full = once.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > KEY_BLOCK)
    full = materialize(full.select("key", F.ceil(F.col("n") / KEY_BLOCK).cast("int").alias("blocks")), "full")
    rows = once.mapInArrow(keyed, "t long, key long, near long, far long").join(full, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("t"), F.col("blocks").cast("long")).cast("int"))
    # a key with many fingerprints: each pair of its blocks is a group, numbered by key and both blocks
    rows = rows.select("t", "key", "near", "far", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.shiftleft(F.least("own", "other").cast("long"), _KEY_BITS).bitwiseOR(F.shiftleft(F.greatest("own", "other").cast("long"), (64 + _KEY_BITS) // 2))
    rows = rows.select("t", F.col("key").bitwiseOR(pair).alias("group"), "near", "far")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.column_stack([c.to_numpy() for c in batch.columns])
            now = now if held is None else np.concatenate([held, now])
            cuts = np.flatnonzero(now[1:, 1] != now[:-1, 1]) + 1
            last = int(cuts[-1]) if len(cuts) else 0  # the last group may go on
            held, now = now[last:], now[:last]
            if len(now):
                yield _edge_batch(*_key_edges(now[:, 1], now[:, 0], now[:, 2:]))
        if held is not None and len(held):
            yield _edge_batch(*_key_edges(held[:, 1], held[:, 0], held[:, 2:]))

    found = rows.repartition("group").sortWithinPartitions("group").mapInArrow(edges, "a long, b long").where("a != b").distinct()
    roots = connected_components(found)
    for x in (once, full):
        drop_scratch(x)
    return roots.select(F.col("node").alias("t"), "root")


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def linked(sets: list[np.ndarray], others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs of sets (rows) and others with at least this Jaccard similarity."""
    sizes = np.array([len(s) for s in others])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    known, place = np.unique(np.concatenate(others), return_inverse=True)
    place, mark, out = place.reshape(-1), np.zeros(len(known) + 1, bool), np.zeros((len(sets), len(others)), bool)
    for i, own in enumerate(sets):
        at = np.searchsorted(known, own)
        at[(at < len(known)) & (known[at.clip(max=len(known) - 1)] != own)] = len(known)
        mark[at] = True
        common = np.add.reduceat(mark[place], starts, dtype=np.int64)
        mark[at] = False
        out[i] = common >= similarity * (sizes + len(own) - common) - 1e-9
    return out


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


def _verified(texts: DataFrame, candidates: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b) edges that connect exactly the candidates of one group that links of this similarity connect.

    Every member of a group is held against its first one, the root. Only those that aren't linked to it are held against
    the whole group, both dealt into blocks, each pair of blocks in a task of its own; so groups of copies of one text cost in proportion.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            held = pa.array([shingles(x.as_py(), k).tobytes() for x in batch.column(2)], pa.binary())
            yield pa.record_batch([*batch.columns[:2], held], names=["t", "root", "held"])

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            near = [bool(linked([a], [b], similarity)[0, 0]) for a, b in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)]
            yield pa.record_batch([*batch.columns[:2], pa.array(near, pa.bool_())], names=["t", "root", "near"])

    # one text of each kind first, merged before texts are shuffled: a text with many copies fills no task
    named = materialize(candidates, "candidates")
    ready = materialize(texts.dropDuplicates(["t"]).join(named, "t").select("t", "root", "text").mapInArrow(sets, "t long, root long, held binary"), "sets", hashes=True)
    # two bare scans: their join can be dealt anew where one root has many members
    first = ready.where("t = root").select("root", F.col("held").alias("lead"))
    leads = materialize(ready.where("t != root").join(first, "root").select("t", "root", "held", "lead").mapInArrow(led, "t long, root long, near boolean"), "leads")
    apart = leads.where("not near").select("t", F.lit(True).alias("apart"))
    sizes = leads.groupBy("root").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("open")).where("open > 0")
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = materialize(sizes.select("root", blocks_of(F.col("n") + 1).alias("blocks"), blocks_of(F.col("open")).alias("turns")), "sizes")
    dealt = ready.join(sizes, "root").join(apart, "t", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    dealt = dealt.withColumns({k: F.pmod(F.xxhash64("t", F.lit(i)), F.col(f"{k}s").cast("long")).cast("int") for i, k in enumerate(("block", "turn"))})
    # a row stays in its own block, for every turn; those apart from the root go, in their turn, through every block as well
    stays = F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda x: F.struct(F.col("block"), x.alias("turn"), F.lit(False).alias("goes")))
    goes = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("block"), F.col("turn"), F.lit(True).alias("goes")))
    dealt = dealt.withColumn("x", F.explode(F.when(F.col("apart"), F.concat(stays, goes)).otherwise(stays)))
    dealt = dealt.select("t", "root", F.col("x.block").alias("block"), F.col("x.turn").alias("turn"), F.col("x.goes").alias("goes"), "apart", "held")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stay, go = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if stay and go:
                a, b = np.nonzero(linked([h for *_, h in go], [h for *_, h in stay], similarity))
                # those that are linked to the root already count as the root
                ids = np.array([t if apart else now[0] for t, apart, _ in stay] + [t for t, *_ in go], np.int64)
                nodes, of = np.unique(ids, return_inverse=True)
                root = _joined(np.arange(len(nodes)), of[len(stay) + a], of[b])
                member = np.flatnonzero(root != np.arange(len(nodes)))
                yield _edge_batch(nodes[root[member]], nodes[member])
            go.clear()

        for batch in slices(batches, BLOCK):
            for t, root, block, turn, goes, apart, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, block, turn) != now:
                    yield from flush()
                    stay.clear()
                    now = root, block, turn
                (go if goes else stay).append((t, apart, np.frombuffer(held, np.uint64)))
                if len(go) == BLOCK:
                    yield from flush()
        yield from flush()

    group = ["root", "block", "turn"]
    crossed = dealt.repartition(*group).sortWithinPartitions(*group, "goes").mapInArrow(work, "a long, b long")
    return leads.where("near").select(F.col("root").alias("a"), F.col("t").alias("b")).unionByName(crossed)


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, repeated rows (id and text) once.

    Rows are told apart by id and text, so unlike texts under one id are documents of their own.
    Near copies have at least this Jaccard similarity over runs of so many words; links of candidates chain. A row without
    an id goes by a number above 2^62 made from its text, so that it stays only where its group has no id below that, and
    equal texts without ids are one document. Texts without words are copies of each other.
    """
    own = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), own), "_text": F.xxhash64("text")})
    texts = docs.select(F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    roots = connected_components(_verified(texts, _candidates(texts, shingle), shingle, similarity))
    rows = keyed.select(F.col("_key").alias("id"), F.col("_text").alias("t"))
    classes = materialize(rows.groupBy("t").agg(F.min("id").alias("id")).join(roots.withColumnRenamed("node", "t"), "t", "left").select("t", "id", F.coalesce("root", "t").alias("root")), "classes")
    keep = classes.groupBy("root").agg(F.min(F.struct("id", "t")).alias("x")).select(F.col("x.id").alias("_id"), F.col("x.t").alias("_t"))
    return keyed.join(keep, (keyed["_key"] == keep["_id"]) & (keyed["_text"] == keep["_t"]), "left_semi").dropDuplicates(["_key", "_text"]).drop("_key", "_text")
