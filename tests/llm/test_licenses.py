import random

import duckdb
from tickweave.llm import licenses


def brute(text):
    words = licenses.words_of(text or "")
    starts, base, more, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        for i in range(len(words) - len(phrase) + 1):
            if tuple(words[i : i + len(phrase)]) == phrase:
                starts.append(i)
                base.add(label)
    for t, label in licenses.TEMPLATES.items():
        want, n = set(licenses.words_of(t)), len(licenses.words_of(t))
        blocks = [licenses.words_of(line) for line in (text or "").split("\n")]
        blocks += [words[max(0, i - n + 1) : i + 1] for i in range(len(words))]
        for have in map(set, blocks):
            if len(want & have) >= 0.8 * len(want) - 1e-9:
                more.add(label)
                score = max(score, len(want & have) / len(want))
    score = 1.0 if starts else score
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), round(score, 9)


def made():
    rng = random.Random(2)
    texts = [None, "", "\n\n", "cc by", "CC-BY cc by", "ccby by cc", "All\nRights\nReserved", "general public license " * 40, "É cc by\x00all rights reserved"]
    common = "the of and to under is license version released work Été".split()
    for _ in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = rng.choice(list(licenses.TEMPLATES)).split() if rng.random() < 0.6 else []
            line = [w for w in line if rng.random() > 0.12] + [rng.choice(common) for _ in range(rng.randrange(8))]
            rng.shuffle(line)
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    return texts


def test_scan_matches_brute_force_and_sql(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(made())]
    rows.append(rows[30])
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)
    got = sorted(((r[0], *r[1:7], round(r[7], 9)) for r in licenses.scan_licenses(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    assert sum(1 for g in got if g[6] and not g[5]) > 20
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, t, _ in rows if "\x00" not in (t or "")])
    sql = sorted(((r[0], *r[1:7], round(r[7], 9)) for r in con.execute(licenses.oracle()).fetchall()), key=str)
    assert sql == [g for g in got if g[0] != 8]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
