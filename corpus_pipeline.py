"""A corpus from raw documents to packed sequences, each stage one operator of tickweave.llm.

Each stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. No stage's decision is made on anything but the rows that it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import decontaminate, near, packing, quality, substring
from tickweave.llm.common import materialize, table

#: A stage is not expressible in SQL (training, genetic search), nor is the whole; tests hold it against brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, predicts to be good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles in common), the one with the smallest id."""
    return near.keep_one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat; n_chars follows. What no passage is taken from keeps its text."""
    return substring.strip_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item is leaked."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.packed_sequences(docs)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontamination", decontamination), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs.select([F.col(c) for c in docs.columns])
