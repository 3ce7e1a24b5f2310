"""Document fingerprints: Merkle trees over paragraphs and sections.

A paragraph is a line, a section a run of paragraphs that ends with a blank one or one whose own digest begins with a
small byte. The leaves of a paragraph are short runs of words that end at words chosen by their hash, with the white space
around them, so an edit moves no boundary elsewhere. A paragraph's digest is made of its leaves' digests, a section's of
its paragraphs', the root of the sections'. The root tests equality; walking down where digests differ locates an edit,
and gives the likeness of two trees: the share, by bytes, of what both have (2 common / (one + other)).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices, with_defaults
from .tokens import U, words_of_all

#: A paragraph whose digest begins with a byte below this ends its section.
SECTION_BYTE = 32

#: One word in so many ends a leaf.
LEAF_WORDS = 3


class Node(NamedTuple):
    """digest, bytes of text below it, and what it is made of; a leaf is made of nothing."""

    digest: bytes
    size: int
    parts: list


class Tree(NamedTuple):
    root: str
    size: int
    sections: list[Node]


def _spans(texts: list[bytes]) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """(start, stop of each leaf within the joined texts, bounds of each line in the leaves, bounds of each text in the lines)."""
    words, at = words_of_all(texts)
    feeds = np.flatnonzero(words.data == 10)
    # lines in order: the k-th least start belongs to the k-th least end
    starts, ends = np.sort(np.concatenate([at[:-1], feeds + 1])), np.sort(np.concatenate([feeds, at[1:]]))
    lines = np.append(0, np.cumsum(np.searchsorted(feeds, at[1:]) - np.searchsorted(feeds, at[:-1]) + 1))
    line = np.searchsorted(feeds, words.start) + words.owner
    last = np.append(line[1:] != line[:-1], True)[: len(line)]  # the end of a line is a cut of its own
    cuts = words.stop[(words.hash % U(LEAF_WORDS) == 0) & ~last]
    full = starts < ends
    start, stop = np.sort(np.concatenate([cuts, starts[full]])), np.sort(np.concatenate([cuts, ends[full]]))
    return start.tolist(), stop.tolist(), np.append(np.searchsorted(start, starts), len(start)), lines


def trees(texts: list[str]) -> list[Tree]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    start, stop, line_bounds, text_bounds = _spans(raw)
    data, known, sha = b"".join(raw), {}, hashlib.sha256
    leaves = []
    for a, b in zip(start, stop, strict=True):
        piece = data[a:b]
        digest = known.get(piece)
        if digest is None:
            known[piece] = digest = sha(b"\0" + piece).digest()
        leaves.append(Node(digest, b - a, ()))
    bounds, out = line_bounds.tolist(), []
    for first, end in zip(text_bounds[:-1].tolist(), text_bounds[1:].tolist(), strict=True):
        sections: list[list[Node]] = [[]]
        for k in range(first, end):
            own = leaves[bounds[k] : bounds[k + 1]]
            digest = sha(b"\1" + b"".join([x.digest for x in own])).digest()
            sections[-1].append(Node(digest, sum([x.size for x in own]), own))
            blank = not own or len(own) == 1 and not data[start[bounds[k]] : stop[bounds[k]]].strip()
            if digest[0] < SECTION_BYTE or blank:
                sections.append([])
        if not sections[-1]:
            sections.pop()
        made = [Node(sha(b"\2" + b"".join([x.digest for x in p])).digest(), sum(x.size for x in p), p) for p in sections]
        out.append(Tree(sha(b"\3" + b"".join([x.digest for x in made])).hexdigest(), sum(x.size for x in made), made))
    return out


def tree(text: str) -> Tree:
    return trees([text])[0]


def _unmatched(a: list[Node], b: list[Node]) -> tuple[int, list[Node], list[Node]]:
    """(bytes of the nodes that both have, the parts of a's other nodes, the parts of b's other nodes)."""
    have, shared, left = Counter([x.digest for x in b]), 0, []
    for x in a:
        if have.get(x.digest, 0):
            have[x.digest] -= 1
            shared += x.size
        else:
            left += x.parts
    right = []
    for x in b:
        if have[x.digest]:
            have[x.digest] -= 1
            right += x.parts
    return shared, left, right


def likeness(a: Tree, b: Tree) -> float:
    """Share of common leaves by bytes, found by going down only where digests differ; 1 for equal roots."""
    if a.root == b.root:
        return 1.0
    common, left, right = 0, a.sections, b.sections
    while left and right:
        shared, left, right = _unmatched(left, right)
        common += shared
    return 2 * common / (a.size + b.size) if common else 0.0


def _differing(a: list, b: list) -> tuple[int, int, int]:
    """(first differing place, end of the differing part in a, in b)."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    return low, len(a) - high, len(b) - high


def locate_edit(a: Tree, b: Tree) -> tuple[int, int, int] | None:
    """(first, end in a, end in b) of the paragraphs that differ; None where the roots are equal."""
    if a.root == b.root:
        return None
    digests = lambda nodes: [x.digest for x in nodes]
    low, end_a, end_b = _differing(digests(a.sections), digests(b.sections))
    before = sum(len(x.parts) for x in a.sections[:low])
    inner = _differing(*(digests(p for x in t.sections[low:end] for p in x.parts) for t, end in ((a, end_a), (b, end_b))))
    return before + inner[0], before + inner[1], before + inner[2]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_from long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edit_from", pa.int64())])


def _compared(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(texts, nexts, strict=True)]
    distinct = list(dict.fromkeys([*texts, *edited, *nexts]))  # the next text is the one of another row
    of = dict(zip(distinct, trees(distinct), strict=True))
    own, other, after = ([of[t] for t in side] for side in (texts, edited, nexts))
    near = [[likeness(a, b) for a, b in zip(own, side, strict=True)] for side in (other, after)]
    edits = [locate_edit(a, b) for a, b in zip(own, other, strict=True)]
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], [t.root for t in own], [t.root for t in other], *near, [e and e[0] for e in edits]]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


#: Code points of the texts that are compared at once.
_AT_ONCE = 1 << 20


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t)
        if size >= _AT_ONCE:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _row(batch: pa.RecordBatch | None, role: int, part: int, doc_id=None, text: str | None = None) -> pa.RecordBatch:
    n = batch.num_rows if batch is not None else 1
    columns = [*(batch.columns if batch is not None else [pa.array([doc_id if f.name == "doc_id" else None], f.type) for f in _SCHEMA])]
    return pa.record_batch([*columns, pa.array([role] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.string())], names=[*_SCHEMA.names, "role", "part", "text"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of ids in order -> results of all but the last (role 0), the first text (1) and the last (2)."""
    part, held = TaskContext.get().partitionId(), None
    for batch in slices(batches):
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        if not ids:
            continue
        if held is None:
            yield _row(None, 1, part, ids[0], texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids[-1], texts[-1]
        for a, b in _slices(texts[:-1]):
            yield _row(_compared(ids[a:b], texts[a:b], texts[a + 1 : b + 1]), 0, part)
    if held is not None:
        yield _row(None, 2, part, *held)


def _last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _compared(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], [t or "" for t in batch.column(2).to_pylist()])


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, per row of docs.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next row's text by
    ascending doc_id (after the last, the first). Rows are dealt out by ranges of doc_id, the text's hash and the row's place
    once and walked in order, so that one id, or none, on many rows fills many ranges; only one first and one last text of
    each range meet in a join on the range's number. Null text is empty; null ids come first; rows with one id follow each
    other by the hash of their texts. Extra columns are ignored; an empty table gives an empty result.
    edit_from is the first paragraph that the trees say differs.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_hash", "_place"]
    keyed = with_defaults(docs, doc_id="long", text="string").withColumns({"_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    walked = materialize(ordered.select("doc_id", "text").mapInArrow(_walk, f"{_COLUMNS}, role int, part int, text string"), "walked")
    heads = walked.where("role = 1").select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    every = Window.orderBy("part")  # one row for each range of ids
    follow = walked.where("role = 1").select("part", F.coalesce(F.lead("part").over(every), F.first("part").over(every)).alias("after"))
    last = walked.where("role = 2").select("part", "doc_id", "text").join(follow, "part").join(heads, "after").select("doc_id", "text", "next_text")
    names = _SCHEMA.names
    return walked.where("role = 0").select(*names).unionByName(last.mapInArrow(_last_rows, _COLUMNS))
