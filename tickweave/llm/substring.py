"""Removal of word passages that repeat anywhere, by level-wise doubling.

A window of `length` words is repeated if the same words start anywhere else. Lengths go up by doubling (9, 18, 35
for 35 words): what is repeated at one length alone is tried at twice that length, until no candidate survives.

* At the first length only anchors count: the leftmost least hash of the short windows inside a full window depends on
  the full window's words alone, so equal full windows have equal anchors at equal places, and about one place in
  fourteen has to be counted.
* What is repeated at a level comes back to the documents as a bitmap of fixed size (BITMAP_BITS). A bit set by
  chance keeps a candidate for the next level, never drops one.
* At the full length, windows with one anchor make one record: an anchor's whole neighbourhood that occurs twice settles
  all its windows in one row; only the other records are taken apart into windows, which are counted over one
  representative of each neighbourhood, so thousands of copies cost as much as two.
* Windows and neighbourhoods are compared by 64-bit hashes, not by their words: of n unlike windows that pass the levels,
  about n^2 / 2^65 pairs are taken for equal by chance, one in 10^6 at n = 10^7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, slices, small_batches, with_defaults
from .tokens import U, join, leftmost_minima, mix, tokens, windows

#: Size of the bitmap of repeated hashes that is broadcast after each level: 16 MiB whatever the input.
BITMAP_BITS = 1 << 27


def levels(length: int) -> list[int]:
    """Lengths in ascending order, each at most twice the one before."""
    out = [length]
    while out[0] > 9:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Anchors:
    """Anchors of one chunk of documents: place, first and last full window that has it, and hashes."""

    def __init__(self, chunk, length: int, base: int):
        self.hashes = chunk.hash
        self.base = base
        self.grams = windows(chunk.hash, base)
        n = max(len(chunk.hash) - length + 1, 0)
        ok = np.flatnonzero(np.arange(n) + length <= chunk.ends[:n])
        at = leftmost_minima(self.grams, length - base + 1)[ok] if n else ok
        new = np.ones(len(ok), bool)
        new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)
        cut = np.flatnonzero(new)
        self.at, self.low = at[cut], ok[cut]
        self.high = ok[np.append(cut[1:], len(ok)) - 1] if len(ok) else ok
        self.owner = chunk.owner[self.low] if len(ok) else ok

    def keep(self, mask: np.ndarray) -> None:
        self.at, self.low, self.high, self.owner = self.at[mask], self.low[mask], self.high[mask], self.owner[mask]

    def narrow(self, level: int, length: int, hit, last: bool) -> list[np.ndarray]:
        """The hashes to count at this level (last), or drop the windows that hit() says aren't repeated at it."""
        if level == self.base:
            found = self.grams[self.at]
            if not last:
                self.keep(hit(found))
            return [found]
        # A full window holds the anchor's extension to the right, or else the one to the left.
        turn = self.at - (length - level)
        grams = windows(self.hashes, level)
        right, left = self.low.clip(min=turn) <= self.high, self.low < turn
        found = [mix(grams[self.at[right]] + U(level)), mix(grams[(self.at - (level - self.base))[left]] + U(level + 1))]
        if not last:
            alive_right, alive_left = np.zeros(len(self.at), bool), np.zeros(len(self.at), bool)
            alive_right[right], alive_left[left] = hit(found[0]), hit(found[1])
            self.low = np.where(alive_left, self.low, np.maximum(self.low, turn))
            self.high = np.where(alive_right, self.high, np.minimum(self.high, turn - 1))
            self.keep((alive_left | alive_right) & (self.low <= self.high))
        return found


def _hit(bitmap: np.ndarray):
    shift = U(64 - (len(bitmap) * 8).bit_length() + 1)
    return lambda h: (bitmap[h >> shift >> U(3)] >> ((h >> shift) & U(7)).astype(np.uint8)) & np.uint8(1) > 0


def _candidates(chunk, length: int, lengths: list[int], bitmaps: list[np.ndarray]) -> _Anchors:
    anchors = _Anchors(chunk, length, lengths[0])
    for level, bitmap in zip(lengths, bitmaps, strict=False):
        anchors.narrow(level, length, _hit(bitmap), last=False)
    return anchors


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the hashes (h) that occur more than once in all (n says how often a row's occurs). At most BITMAP_BITS."""
    place = F.shiftrightunsigned("h", 64 - BITMAP_BITS.bit_length() + 1)
    repeated = hashes.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = repeated.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = words.toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out.astype("<u8").view(np.uint8)


def _counted(batch_hashes: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(batch_hashes) if batch_hashes else np.zeros(0, np.uint64), return_counts=True)
    return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _text_key(text: str = "text") -> Column:
    return F.xxhash64(text)


def repeated_ranges(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, mark, spans): words low..high of the row's text are covered by repeated windows, for each span.

    mark is xxhash64 of the text and tells rows with one doc_id apart. Spans of a row may overlap. Equal rows have one row
    here, however many they are, and its spans once: sets are merged before they are shuffled.
    """
    spark, lengths, bitmaps = docs.sparkSession, levels(length), []

    def level_counts(k: int, shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for chunk in tokens(batch.column(0)):
                    found += _candidates(chunk, length, lengths, shared.value).narrow(lengths[k], length, None, last=True)
                yield _counted(found)

        return work

    for k in range(len(lengths) - 1):
        shared = spark.sparkContext.broadcast(list(bitmaps))
        with small_batches(spark):
            bitmaps.append(_bitmap(docs.select("text").mapInArrow(level_counts(k, shared), "h long, n long")))
        shared.unpersist()
    shared = spark.sparkContext.broadcast(bitmaps)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tokens(batch.column(2)):
                a = _candidates(chunk, length, lengths, shared.value)
                if not len(a.at):
                    continue
                full = windows(chunk.hash, length)
                sizes = a.high - a.low + 1
                stops = np.cumsum(sizes)
                inner = np.arange(stops[-1]) - np.repeat(stops - sizes, sizes) + np.repeat(a.low, sizes)
                # the first and the last window of the record hold all its words; its span is too short for a gap between them
                whole = mix(join(full[a.low], full[a.high]) + (a.at - a.low).astype(np.uint64) * U(64) + sizes.astype(np.uint64))
                own = chunk.first + a.owner
                take = pa.array(own)
                yield pa.record_batch(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(whole.view(np.int64)), pa.array(a.low - chunk.bounds[a.owner]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(full[inner].view(np.int64)))],
                    names=["doc_id", "mark", "whole", "low", "n", "inner"],
                )

    kept = materialize(docs.select("doc_id", _text_key().alias("mark"), "text").mapInArrow(records, "doc_id long, mark long, whole long, low long, n long, inner array<long>"), "records", hashes=True)
    shared.unpersist()
    classes = kept.groupBy("whole").agg(F.count("*").alias("n"), F.any_value("inner").alias("inner"))
    single = F.when(F.col("n") == 1, F.col("whole"))
    places = classes.select(single.alias("single"), F.posexplode("inner").alias("at", "h"))
    # a window of one neighbourhood that occurs once is repeated if another neighbourhood has it
    windows_of = places.groupBy("h").agg(F.count("*").alias("n"), F.count("single").alias("singles")).where("n > 1 and singles > 0").select("h")
    alone = classes.where("n = 1").select("whole", F.posexplode("inner").alias("at", "h"))
    again = alone.join(windows_of, "h").groupBy("whole").agg(F.collect_set("at").alias("hits"))
    many = classes.where("n > 1").select("whole", F.lit(None).cast("array<int>").alias("hits"))
    # written, so that both sides of the next join come from exchanges of their own, which can be split where a neighbourhood is very common
    verdict = materialize(many.unionByName(again), "verdicts")
    where = kept.select("doc_id", "mark", "whole", "low", "n").join(verdict, "whole")
    full_range = F.array(F.struct(F.col("low"), (F.col("low") + F.col("n") + length - 2).alias("high")))
    some = F.transform("hits", lambda at: F.struct((F.col("low") + at).alias("low"), (F.col("low") + at + length - 1).alias("high")))
    spans = F.when(F.col("hits").isNull(), full_range).otherwise(some)
    out = materialize(where.select("doc_id", "mark", spans.alias("spans")).groupBy("doc_id", "mark").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    for done in (kept, verdict):
        drop_scratch(done)
    return out


def _removed(n: int, spans: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["low"]] += 1
        edge[s["high"] + 1] -= 1
    return np.cumsum(edge[:n]) > 0


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    spans = repeated_ranges(docs.select("doc_id", "text"), length).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    marked = docs.withColumn("_own", _text_key())
    return marked.join(spans, marked["doc_id"].eqNullSafe(spans["_id"]) & (marked["_own"] == spans["_mark"]), "left").drop("_id", "_mark", "_own")


def deduplicate_passages(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, text without repeated passages (kept words joined by one space), n_words, n_removed per row of docs.

    Every word covered by a window of `length` words that starts anywhere else too goes, both occurrences. Null text has
    no words; texts under `length` words lose nothing. Rows with equal or null ids are kept apart. Extra columns are dropped.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, removed = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = _removed(len(words), spans.as_py())
                lost = int(gone.sum())
                texts.append(b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x) if lost else b" ".join(words))
                counts.append(len(words))
                removed.append(lost)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    rows = _with_spans(with_defaults(docs, doc_id="long", text="string"), length)
    return rows.select("doc_id", "text", "spans").mapInArrow(work, "doc_id long, text string, n_words long, n_removed long")


def strip_passages(docs: DataFrame, length: int = 35) -> DataFrame:
    """The rows of docs with repeated passages taken out of text, other columns as they are but n_chars, which follows.

    A text that loses words keeps the others joined by one space; any other text, null included, stays as it is.
    """
    columns = docs.columns
    at, schema = columns.index("text"), docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, lengths = [], []
            for text, spans in zip(batch.column(at), batch.column(len(columns)), strict=True):
                text = text.as_py()
                if spans.is_valid and len(spans):
                    words = text.encode("utf-8", "surrogatepass").split()
                    gone = _removed(len(words), spans.as_py())
                    text = b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x).decode("utf-8", "surrogatepass")
                texts.append(text)
                lengths.append(None if text is None else len(text))
            new = [batch.column(i) for i in range(len(columns))]
            new[at] = pa.array(texts, new[at].type)
            if "n_chars" in columns:
                k = columns.index("n_chars")
                new[k] = pa.array(lengths, pa.int64()).cast(new[k].type)
            yield pa.record_batch(new, names=columns)

    return _with_spans(docs, length).select(*columns, "spans").mapInArrow(work, schema)


def passage_report(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what deduplicate_passages() leaves."""
    return deduplicate_passages(docs, length).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def oracle(length: int = 35) -> str:
    """DuckDB SQL for passage_report() over the view documents."""
    return f"""with rows as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
  split as (select id, doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from rows),
  words as (select id, unnest(w) as word, unnest(range(len(w))) as i from split),
  wins as (select id, i, count(*) over f as n, md5(string_agg(word, ' ') over f) as h from words window f as (partition by id order by i rows between current row and {length - 1} following)),
  again as (select h from wins where n = {length} group by h having count(*) > 1),
  hits as (select id, i from wins semi join again using (h) where n = {length}),
  gone as (select distinct id, i + k.range as i from hits, range({length}) k),
  left_over as (select id, string_agg(word, ' ' order by i) as text, count(*) as n from words anti join gone using (id, i) group by id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(l.text, '')) as kept_sha256 from split left join left_over l using (id)"""
