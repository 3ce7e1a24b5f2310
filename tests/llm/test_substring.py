import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tickweave.llm import substring, tokens


def brute(texts, length):
    split = [(t or "").encode().split() for t in texts]
    seen = {}
    for d, w in enumerate(split):
        for p in range(len(w) - length + 1):
            seen.setdefault(tuple(w[p : p + length]), []).append((d, p))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d].update(range(p, p + length))
    return [(len(w), len(g), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in g)).hexdigest()) for w, g in zip(split, gone)]


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "cé", "D", "ee"]) + str(rng.randrange(40))
    passage = [[word() for _ in range(rng.choice([20, 35, 36, 50, 90]))] for _ in range(6)]
    texts = [None, "", "  \n", "one"]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice(passage) if rng.random() < 0.4 else [word() for _ in range(rng.randrange(1, 60))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += ["x " * 34, "x " * 35, "x " * 36, "p q " * 40, "y " * 300, texts[5], texts[5]]
    return texts


def test_token_and_window_hashes_agree_with_python_splitting():
    texts = made(3) + [" lead", "trail ", "\x0bmid\x0cdle\r"]
    column = pa.array(texts).slice(2)
    got, at = [], 0
    for chunk in tokens.tokens(column):
        for i in range(len(chunk.bounds) - 1):
            a, b = chunk.bounds[i : i + 2]
            got.append([bytes(chunk.data[x:y]) for x, y in zip(chunk.start[a:b], chunk.stop[a:b])])
            assert (chunk.hash[a:b] == np.array([tokens.token_hash(w.decode()) for w in got[-1]], np.uint64)).all()
    assert got == [(t or "").encode().split() for t in texts[2:]]


@pytest.mark.parametrize("length", [35, 9, 12])
def test_ranges_match_brute_force(spark, length):
    texts = made(length)
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string, low int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.passage_report(df, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)
    assert sum(x[1] for x in got.values()) > 0


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (1, "other words"), (None, text + " z"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.passage_report(df).collect())
    assert got == [(0, 41, 40), (1, 2, 0), (1, 40, 40), (1, 40, 40), (2, 0, 0)]
    assert substring.passage_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_equal_rows_cost_in_proportion(spark, doc_id):
    text = " ".join(f"w{i}" for i in range(600))
    sizes = []
    for n in (40, 160):
        df = spark.createDataFrame([(doc_id, text)] * n + [(8, "other " * 3)], "doc_id long, text string")
        spans = substring.repeated_ranges(df).collect()
        assert [r.doc_id for r in spans] == [doc_id]  # one row for all copies
        sizes.append(len(spans[0].spans))
        got = substring.deduplicate_passages(df).collect()
        assert len(got) == n + 1 and all(r.n_removed == (600 if r.n_words == 600 else 0) for r in got)
    assert sizes[0] == sizes[1]
