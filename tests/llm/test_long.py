"""Very long texts, pages and URLs among short ones, and columns that clash with those that operators add."""

import random

from tickweave.llm import decontaminate, layout, licenses, merkle, packing, quality, simhash, substring, urls, warc

RNG = random.Random(9)
LONG = " ".join(f"w{RNG.randrange(500)}" for _ in range(120_000))
SAME = "a " * 60_000
ITEM = " ".join(f"item{i}" for i in range(30))


def docs(spark):
    rows = [(1, LONG, 1, "x"), (2, SAME, 2, "x"), (3, LONG + " " + ITEM, 3, "x"), (4, "short text", 4, "x"), (5, None, 5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int, score string")


def test_documents(spark):
    df = docs(spark)
    assert simhash.near_duplicate_classes(df).count() == 5
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    assert quality.quality_scores(df, labels).where("score between 0 and 1").count() == 5
    pieces = packing.packed_sequences(df).groupBy("doc_id").sum("length").collect()
    assert len(pieces) == 5 and min(r[1] for r in pieces) == 1
    assert merkle.edit_fingerprints(df).where("near_edited between 0 and 1 and near_next between 0 and 1").count() == 5
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring.passage_report(df).collect()}
    assert removed == {1: (120_000, 120_000), 2: (60_000, 60_000), 3: (120_030, 120_000), 4: (2, 0), 5: (0, 0)}
    bench = spark.createDataFrame([(7, ITEM), (8, "a " * 12)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leak_report(df, bench).collect()} == {(3, 7), (2, 8)}
    scanned = {r.doc_id: r for r in licenses.scan_licenses(df.withColumn("text", licenses.F.concat("text", licenses.F.lit(" CC BY")))).collect()}
    assert scanned[1].n_words == 120_002 and scanned[1].first_word == 120_000 and scanned[5].n_words == 0


def test_pages(spark):
    big = "<ul>" + "<li>word <b>and</b> more" * 40_000
    rows = [(1, "http://long.net/es/" + "q/" * 20_000, big, "x"), (2, "http://a.com/", "<p>hi", "x"), (3, "http://b.org/", None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    text = {r.page_id: r.text for r in layout.extract_text(df).collect()}
    assert text[1].count("- word and more") == 40_000 and text[2] == "hi" and text[3] == ""
    assert warc.archive_round_trip(df).where("record_type = 'response'").count() == 3
    assert {r.page_id: r.rule for r in urls.judge_urls(df).collect()} == {1: "net/es/", 2: "com/", 3: None}
