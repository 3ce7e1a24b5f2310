import textwrap

import duckdb
import pytest

from tickweave.llm import licenses


def test_wrapped_notices_keep_their_labels(spark):
    notices = {t: label for t, label in licenses.TEMPLATES.items() if len(t) > 60}
    rows = []
    for width in (30, 45, 72):
        for mark in ("", " * ", "# "):
            for t, label in notices.items():
                lines = textwrap.wrap(f"{t} and so forth", width)
                rows.append((len(rows), "code before\n" + "\n".join(mark + x for x in lines) + "\ncode after", label))
    # words of a notice that lie far apart are none
    apart = "\n".join(w + " x" * 40 for w in "Redistribution and use in source and binary forms with or without modification are permitted".split())
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([*[r[:2] for r in rows], (999, apart)], "doc_id long, text string")).collect()}
    for i, text, label in rows:
        assert label in got[i].labels.split(",") and got[i].score == 1.0, text
    assert got[999].labels == ""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [*[r[:2] for r in rows], (999, apart)])
    assert {r[0]: r[6] for r in con.execute(licenses.oracle()).fetchall()} == {i: r.labels for i, r in got.items()}


def test_templates_from_a_table(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "may be used\nunder our House licence only"), (2, "Released under the MIT License")], "doc_id long, text string")
    table = spark.createDataFrame([("May be used under our house licence", "house", 1), (None, "x", 2), (" - ", "y", 3)], "text string, label string, score int")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(docs, table).collect()} == {1: "house", 2: ""}
    monkeypatch.setattr(licenses, "TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError, match="bytes of templates"):
        licenses.scan_licenses(docs, table)
