import hashlib
import random
import re
from collections import Counter

import pytest
from tickweave.llm import merkle, tokens


def bag_of_leaves(text):
    """Leaves by the definition, one word at a time."""
    out = Counter()
    for line in text.encode().split(b"\n"):
        words, start = list(re.finditer(rb"[^\x20\x09-\x0d]+", line)), 0
        for w in words[:-1]:
            if int(tokens.token_hash(w[0].decode())) % merkle.LEAF_WORDS == 0:
                out[line[start : w.end()]] += 1
                start = w.end()
        if line:
            out[line[start:]] += 1
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    a, b = bag_of_leaves(a), bag_of_leaves(b)
    common, total = (sum(len(x) * n for x, n in c.items()) for c in (a & b, a + b))
    return 2 * common / total if common else 0.0


def made():
    rng = random.Random(5)
    texts = [None, "", "abc", "\n\n", "été ü"]
    for _ in range(60):
        texts.append("\n".join(" ".join(rng.choice(["the", "of", "blein", "été"]) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 14))))
    return texts + [texts[9], "z" * 100_000]


def test_rows_match_the_definition(spark):
    texts = made()
    ids = random.Random(1).sample(range(-50, 5000), len(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, fingerprint string, part int").repartition(6)
    got = {r.doc_id: r for r in merkle.edit_fingerprints(df).collect()}
    assert len(got) == len(texts)
    ordered = sorted((i, t or "") for i, t in zip(ids, texts))
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == merkle.tree(t).root and r.edited_fingerprint == merkle.tree(edited).root
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        assert r.near_edited == pytest.approx(brute_likeness(t, edited)) and r.near_next == pytest.approx(brute_likeness(t, after))
        assert (t != edited or r.near_edited == 1) and (t != after or r.near_next == 1)
        if t != edited:
            lines = list(zip(t.split("\n"), edited.split("\n")))
            assert r.edit_from == next((j for j, (a, b) in enumerate(lines) if a != b), len(lines))
    close = [(r.near_edited, r.near_next) for r in got.values() if r.n_chars > 400]
    assert sum(a > b for a, b in close) > 0.95 * len(close)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    (r,) = merkle.edit_fingerprints(df).collect()
    assert r.near_next == 1.0 and 0 < r.near_edited < 1
    assert merkle.edit_fingerprints(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "b"), (None, "a"), (2, "x"), (2, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.near_next) for r in merkle.edit_fingerprints(twice).collect()) == [(0, 0.0), (0, 0.0), (2, 0.0), (2, 1.0)]


def test_locating_an_edit():
    a = merkle.tree("\n".join(f"line {i}" for i in range(200)))
    b = merkle.tree("\n".join(f"line {i}" if i not in (70, 71) else "changed" for i in range(200)))
    assert merkle.locate_edit(a, b) == (70, 72, 72) and merkle.locate_edit(a, a) is None


def test_nodes_are_made_of_their_parts():
    a = merkle.tree("\n\n  \nalpha beta gamma\n delta \n\nlast one ")
    sha = lambda mark, parts: hashlib.sha256(mark + b"".join(x.digest for x in parts)).digest()
    assert a.root == sha(b"\3", a.sections).hex()
    for section in a.sections:
        assert section.digest == sha(b"\2", section.parts)
        for paragraph in section.parts:
            assert paragraph.digest == sha(b"\1", paragraph.parts)
    lines = [p for s in a.sections for p in s.parts]
    assert len(lines) == 7 and [len(p.parts) for p in lines][:3] == [0, 0, 1]
    texts = ["a b", "a  b", "a b ", " a b", "a\nb", "a b\n", "", "\n", " ", "ab"]
    assert len({t.root for t in merkle.trees(texts)}) == len(texts)
    assert [t.root for t in merkle.trees(texts)] == [merkle.tree(t).root for t in texts]


def test_one_id_on_many_rows_is_dealt_out(spark):
    df = spark.createDataFrame([(None, f"text {i} of many") for i in range(200)] + [(5, "same")] * 200, "doc_id long, text string").repartition(4)
    parts = merkle.edit_fingerprints(df)
    assert parts.count() == 400
    assert parts.where("doc_id = 5 and near_next = 1").count() == 199
