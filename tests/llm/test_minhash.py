import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tickweave.llm import minhash


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[i : i + 2]) for i in range(max(len(words) - 1, 1))} if words else set()


def brute(rows):
    """The expected row of each input row, by comparing all pairs."""
    sets = [brute_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    lowest = {r: min((d for (d, *_), x in zip(rows, root, strict=True) if x == r and d is not None), default=None) for r in root}
    return sorted(((d, len(s), lowest[r], d == lowest[r]) for (d, *_), s, r in zip(rows, sets, root, strict=True)), key=repr)


def edited(rng, text, share):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in text.split())


def made(seed, n=40):
    rng, out = random.Random(seed), []
    for _ in range(n):
        out.append(" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 400))))
        out += [edited(rng, out[-1], share) for share in (0.0, 0.01, 0.03, 0.04, 0.1)]
    # a family of copies of copies, where many pairs are near the threshold
    base = " ".join(f"v{rng.randrange(3000)}" for _ in range(300))
    out += [edited(rng, base, 0.05) for _ in range(60)]
    return out


def got(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, digest string, root long, c int").repartition(parts)
    return sorted((tuple(r) for r in minhash.near_duplicate_report(df).collect()), key=repr)


@pytest.mark.parametrize("block", [7, 256])
def test_components_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "KEY_BLOCK", block)
    odd = [None, "", " \n\t", "word", "WORD", "word word", "word word word", "Ärger é", "ärger é", "a b c d e f", "a b c d e f g", "A  B\x0bC D E F", "a\x85b"]
    rows = [(i + 1, t, 1, "clash", i, 2) for i, t in enumerate(made(3) + odd)]
    rows += [(None, rows[0][1], 1, "", 0, 0), (None, "only here", 1, "", 0, 0), (None, "ONLY here", 1, "", 0, 0), (None, None, 0, "", 0, 0), rows[5], (5, "another text of one id", 0, "", 0, 0), (-9, rows[200][1], 0, "", 0, 0)]
    out = got(spark, rows)
    assert out == [(d, n, c, d == c) for d, n, c, _ in brute(rows)]
    assert 60 < len({r[2] for r in out}) < 200


def test_empty_tables_and_lone_texts(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, "a b", 0, "", 0, 0), (2, None, 0, "", 0, 0), (3, "", 0, "", 0, 0)]) == [(1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_a_group_of_copies_and_a_very_long_text(spark):
    long = " ".join(f"x{i % 70_001}" for i in range(300_000))
    rows = [(i, "the same text in each of these many rows of one large group", 0, "", 0, 0) for i in range(3000)] + [(5000, long, 0, "", 0, 0), (5001, long + " end", 0, "", 0, 0), (5002, long, 0, "", 0, 0)]
    out = {r[0]: r[1:] for r in got(spark, rows)}
    assert all(out[i] == (12, 0, i == 0) for i in range(3000))
    assert out[5000] == (70_001, 5000, True) and out[5001] == (70_002, 5000, False) and out[5002] == (70_001, 5000, False)


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 256, minhash.SYMBOLS, dtype=np.uint8)
        b = a.copy()
        at = rng.permutation(minhash.SYMBOLS)[: minhash.MAX_DISTANCE]
        b[at] ^= rng.integers(1, 256, len(at), dtype=np.uint8)
        x, y = minhash.patterns(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())
    x, y = minhash.patterns(rng.integers(0, 256, (2, minhash.SYMBOLS), dtype=np.uint8))
    assert not set(x.tolist()) & set(y.tolist())


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    distances = []
    for _ in range(400):
        common, own = [f"s{rng.random()}" for _ in range(160)], [[f"s{rng.random()}" for _ in range(20)] for _ in "ab"]
        sets = [np.unique(minhash.mix(np.array([hash(w) & (1 << 63) - 1 for w in common + o], np.uint64))) for o in own]
        a, b = minhash.signatures(sets)
        distances.append(int((a != b).sum()))
    assert abs(np.mean(distances) - 0.2 * 64 * 255 / 256) < 0.6  # 160 of 200 in common
    assert max(distances) <= minhash.MAX_DISTANCE + 3 and np.mean([d <= minhash.MAX_DISTANCE for d in distances]) > 0.99


def test_sets_of_short_texts():
    texts = ["", "one", "one two", "one two one two", None]
    assert [len(s) for s in minhash.shingle_sets(pa.array(texts))] == [0, 1, 1, 2, 0]
