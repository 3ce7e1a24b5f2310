"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits, and runs of punctuation. One- and two-token n-grams, of the tokens and of their
shapes, are hashed to 2^BITS places; a text's value at a place is the count there over the root of the number of its n-grams, so a score is a sparse dot
product that needs no vocabulary. Training takes at most `max_rows` labelled texts (those with the least hash of the
id, a sample that doesn't depend on partitions) in one task; scoring runs over all texts where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, with_defaults
from .tokens import U, WORDS_AND_MARKS, join, mix, tokens

BITS = 18

#: Labelled texts that are trained on at most, and passes over them.
MAX_ROWS, EPOCHS = 8_000, 2

#: Follow-the-regularised-leader: learning rate, its offset, and the L1 and L2 penalties. L1 leaves about one weight in a hundred.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.1

THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that is never trained on; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _shape(chunk) -> np.ndarray:
    """A small number for how each token looks: which punctuation, or whether a word begins and ends in a capital or a digit."""
    kind = _LOOKS[chunk.data]
    first, last = kind[chunk.start].astype(np.uint64), kind[chunk.stop - 1].astype(np.uint64)
    return np.where(first < 4, first * U(4) + last, U(16) + chunk.data[chunk.start])


_LOOKS = np.full(256, 4, np.uint8)  # punctuation
_LOOKS[48:58], _LOOKS[65:91], _LOOKS[97:123], _LOOKS[128:] = 0, 1, 2, 3


def _places(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some documents at a time: the hashed places of all their n-grams, and where each document's begin and end.

    Each token gives itself, the pair with the next token, and the pair of both tokens' shapes; a token that comes again
    at once or after another one gives a place for that, whatever the token. So words never seen before still count.
    """
    for chunk in tokens(column, WORDS_AND_MARKS):
        h, n = chunk.hash, len(chunk.hash)
        if not n:
            yield np.zeros(0, np.int64), np.zeros(len(chunk.bounds), np.int64)
            continue
        shape, grams, keep = _shape(chunk), np.empty((n, 5), np.uint64), np.zeros((n, 5), bool)
        left = chunk.ends - np.arange(n)  # tokens from here to the document's end
        grams[:, 0], keep[:, 0] = h, True
        grams[:-1, 1], keep[:, 1] = join(h[:-1], h[1:]), left > 1
        grams[:-1, 2], keep[:, 2] = mix(shape[:-1] * U(1024) + shape[1:] + U(1 << 40)), left > 1
        for k in (1, 2):
            grams[:, 2 + k] = mix(np.array([k], np.uint64) + U(1 << 41))
            keep[:-k, 2 + k] = (h[:-k] == h[k:]) & (left[:-k] > k)
        ends = np.append(0, np.cumsum(keep.sum(axis=1)))
        yield (grams[keep] >> U(64 - BITS)).astype(np.int64), ends[chunk.bounds]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows: list[tuple[bytes, bytes]] = []
        for places, bounds in _places(batch.column(2)):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                at, n = np.unique(places[a:b], return_counts=True)
                rows.append((at.astype("<i4").tobytes(), (n / np.sqrt(max(b - a, 1))).astype("<f4").tobytes()))
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], names=["rank", "label", "at", "value"])


class FtrlLogistic:
    """Follow-the-proximally-regularised-leader with a rate for each place."""

    def __init__(self, size: int):
        self.z, self.n, self.bias = np.zeros(size), np.zeros(size), np.zeros(2)

    @staticmethod
    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        z, n = self.z[at], self.n[at]
        w, b = self.weights(z, n), -self.bias[0] / ((BETA + np.sqrt(self.bias[1])) / ALPHA)
        error = 1.0 / (1.0 + np.exp(-np.clip(w @ value + b, -35, 35))) - label
        g = error * value
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias += (error - (np.sqrt(self.bias[1] + error**2) - np.sqrt(self.bias[1])) / ALPHA * b, error**2)

    def packed(self) -> bytes:
        bias = -self.bias[0] / ((BETA + np.sqrt(self.bias[1])) / ALPHA)
        return np.append(self.weights(self.z, self.n), bias).astype("<f4").tobytes()


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(np.frombuffer(at.as_py(), "<i4"), np.frombuffer(v.as_py(), "<f4"), int(y.as_py())) for batch in batches for y, at, v in zip(*batch.columns[1:], strict=True)]
    model = FtrlLogistic(1 << BITS)
    for _ in range(EPOCHS):
        for at, value, label in rows:
            model.learn(at, value, label)
    yield pa.record_batch([pa.array([model.packed()], pa.binary())], names=["model"])


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """2^BITS weights and the bias, learned from labelled documents that aren't held out. No labels: all zero."""
    known = with_defaults(labels, doc_id="long", quality="int").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label")).withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(max_rows)
    texts = with_defaults(docs, doc_id="long", text="string").join(F.broadcast(known), "doc_id")
    # of several texts under one id the one with the least hash, whatever the partitions; hashes alone are shuffled
    least = texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("_hash"))
    texts = texts.join(F.broadcast(least), "doc_id").where(F.xxhash64("text") == F.col("_hash")).select("rank", "label", "text").dropDuplicates(["rank"])  # max_rows at most
    examples = texts.mapInArrow(_examples, "rank long, label int, at binary, value binary")
    models = examples.repartition(1).sortWithinPartitions("rank").mapInArrow(_fit, "model binary").collect()
    return np.frombuffer(models[0]["model"], "<f4") if models else np.zeros((1 << BITS) + 1, "<f4")


def score_quality(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs; null and empty texts have the bias alone as score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches):
            logits = []
            for places, bounds in _places(batch.column(1)):
                sums = np.append(0.0, np.cumsum(w[places], dtype=np.float64))
                logits.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(np.diff(bounds), 1)))
            score = 1.0 / (1.0 + np.exp(-(np.concatenate(logits) if logits else np.zeros(0)) - float(w[-1])))
            yield pa.record_batch([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = with_defaults(docs, doc_id="long", text="string").mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled rows of docs and score all its rows.

    Rows with null or repeated ids are scored as any other; labels that are null, neither 0 nor 1, or of unknown documents
    are ignored, of several labels the highest counts, of several texts under one id the one with the least hash. Extra columns play no part. Empty docs give an empty result.
    """
    return score_quality(docs, train_quality(docs, labels, max_rows), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier predicts to be good, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, max_rows))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        limit = np.log(threshold / (1 - threshold)) - float(w[-1])
        for batch in slices(batches):
            good = []
            for places, bounds in _places(batch.column(at)):
                sums = np.append(0.0, np.cumsum(w[places], dtype=np.float64))
                good.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(np.diff(bounds), 1)) >= limit)
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(work, docs.schema)
