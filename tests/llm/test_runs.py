import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tickweave.llm import runs


def brute_runs(words):
    """Every maximal stretch of every period, the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, q, n) for (s, n), q in best.items())


def found(words):
    r = runs.find_runs(runs.numbered([str(w).encode() for w in words]))
    return list(zip(r.start.tolist(), r.period.tolist(), r.length.tolist(), strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=8))
def test_runs_of_stuttering_words(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert found(words) == brute_runs(words)


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    words = [rng.randrange(1 + seed % 4) for _ in range(rng.randrange(400))]
    if seed % 3 == 0:
        words += words[-37:] * 5 + words[:11] * 9
    assert found(words) == brute_runs(words)


def test_least_lengths():
    assert found("aaaaa") == [] and found("aaaaaa") == [(0, 1, 6)]
    assert found("abababa") == [] and found("xabababab") == [(1, 2, 8)]
    assert found("") == [] and found("a") == []
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(4, np.int32), periods=3)


def test_long_texts_of_one_word_and_of_none_alike():
    start = time.time()
    assert found([0] * 100_000) == [(0, 1, 100_000)]
    assert found(range(300_000)) == []
    assert found([*range(5_000)] * 20) == [(0, 5_000, 100_000)]
    assert time.time() - start < 30


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    all_runs = brute_runs(words)
    gone = {i for s, q, size in all_runs for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, q, size in all_runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    return (doc_id, len(all_runs), *shown, sha("".join(f"{s},{size},{q}\n" for s, q, size in all_runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_report_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(w for _ in range(rng.randrange(12)) for w in rng.choices("abc", k=rng.randrange(1, 5)) * rng.randrange(1, 7)) for _ in range(120)]
    texts += [None, "", " \n", "é é é é é é", "x y x y x y x y", "A a A a A a A a", "one\x0btwo " * 6]
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)] + [(None, "a a a a a a a", 2, ""), (-7, texts[3], 0, None), (3, texts[3], 0, None)]
    got = runs.run_report(spark.createDataFrame(rows, "doc_id long, text string, id int, runs string").repartition(5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(d, t)) for d, t, *_ in rows)
    assert sum(r.n_runs > 0 for r in got) > 30
    assert runs.run_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_report_over_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    small = [r for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in runs.run_report(docs).collect()}
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in small) and len(small) > 150
