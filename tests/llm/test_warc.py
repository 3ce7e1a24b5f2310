import gzip
import hashlib
import json
import os

import duckdb
from tickweave.llm import warc

LONG = "<p>" + "héllo\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9
PAGES = [(3, "http://a/", LONG), (1, "http://b/\r\nX: y", LONG), (2, None, LONG), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""), (11, "u", "x" * 3_000_000), (None, "u", LONG), (1, "http://b/", LONG)]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


def want():
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        to = first.get(h) if first.get(h) != i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_round_trip_and_sql(spark):
    df = frame(spark)
    assert sorted(map(tuple, warc.archive_round_trip(df).collect()), key=str) == want()
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    assert sorted(con.execute(warc.oracle()).fetchall(), key=str) == want()
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_files_are_members_with_a_sidecar(spark, tmp_path):
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    warc.write_archives(frame(spark).coalesce(1), raw)
    index = warc.normalise_archives(spark, raw, out).collect()
    assert len(index) == len(PAGES)
    for name in (n for n in os.listdir(tmp_path / "out") if n.endswith(".warc.gz")):
        whole = (tmp_path / "out" / name).read_bytes()
        rows = [json.loads(x) for x in (tmp_path / "out" / f"{name}.idx").read_text().splitlines()]
        assert sum(r["length"] for r in rows) == len(whole)
        for r in rows:
            record = gzip.decompress(whole[r["offset"] : r["offset"] + r["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and r["record_id"].encode() in record
    again = {r.offset for r in warc.read_records(spark.createDataFrame(index)).collect()}
    assert again >= {r.offset for r in index}
