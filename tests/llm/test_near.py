import random

import numpy as np
from tickweave.llm import near, tokens


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def made(seed, n):
    rng = random.Random(seed)
    rows, origins = [], []
    for _ in range(n):
        origins.append(" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))))
        rows.append(origins[-1])
        # an edited word spoils five shingles of some 250
        rows += [edited(rng, origins[-1], max(1, round(len(origins[-1].split()) * share))) for share in (0.005, 0.015, 0.02, 0.03)]
    return rows


def test_near_copies_are_found_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    monkeypatch.setattr(near, "KEY_BLOCK", 2)
    texts = [*made(1, 40), "", None, " ", "one two", "ONE  two", "one three"]
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    kept = near.keep_one_of_each(df)
    got = {r.doc_id for r in kept.collect()}
    assert got == set(root) and 40 < len(got) < len(texts) - 80
    assert near.keep_one_of_each(df.limit(0)).count() == 0


def candidates(a, b):
    """Whether a chain of the two fingerprints holds, by a plain loop."""
    bits = [bin(int(x) ^ int(y)).count("1") for x, y in zip(near.fingerprint(a), near.fingerprint(b), strict=True)]
    for i in range(near.SEGMENTS):
        if bits[i] == 0 and all(sum(bits[(i + k) % near.SEGMENTS] for k in range(n)) <= near.BUDGET * n for n in range(1, near.CHAIN + 2)):
            return True
    return False


def test_fingerprint_is_the_majority():
    have = np.random.default_rng(1).integers(0, 1 << 63, 601, dtype=np.uint64)
    hashes = tokens.mix(have[:, None] + near._WORDS)
    want = 2 * np.unpackbits(hashes.view(np.uint8).reshape(601, -1), axis=1).sum(axis=0, dtype=np.int64) > 601
    assert (np.unpackbits(near.fingerprint(have).view(np.uint8)).astype(bool) == want).all()


def test_chains_meet_at_the_threshold_and_no_unlike_pair_does():
    rng, met, n = np.random.default_rng(3), 0, 400
    for _ in range(n):
        base = rng.integers(0, 1 << 63, 270, dtype=np.uint64)
        met += candidates(base[:243], base[27:])  # 216 of 270 are common: 0.8
        assert not candidates(base[:135], base[135:])
    assert met >= 0.97 * n


def test_key_edges_connect_what_chains_connect():
    rng = np.random.default_rng(4)
    prints = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        prints += [near.fingerprint(np.concatenate([base[: 300 - x], rng.integers(0, 1 << 63, x, dtype=np.uint64)])) for x in (0, 3, 9, 15, 40)]
    prints = np.array(prints)
    keys, chains = near.ring(prints)
    order = np.argsort(keys, kind="stable")
    t = np.repeat(np.arange(len(prints)), near.SEGMENTS)[order]
    a, b = near._key_edges(keys[order], t, chains[order])
    root = near._joined(np.arange(len(prints)), a, b)
    want = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            bits = np.bitwise_count(prints[i] ^ prints[j]).astype(int)
            if any(bits[k] == 0 and all(np.roll(bits, -k)[:n].sum() <= near.BUDGET * n for n in range(1, near.CHAIN + 2)) for k in range(near.SEGMENTS)):
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert root.tolist() == want and len(set(want)) < 30


def test_unlike_texts_under_one_id_both_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    # id 7: two unlike texts, one row repeated; id 8: a copy of id 7's text, and a text of its own; id 9: two near copies
    rows = [(7, a), (7, b), (7, a), (8, a), (8, c), (9, "d e f g h i j " * 9), (9, "D e f g h i j " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.text.lower()) for r in near.keep_one_of_each(df).collect())
    assert got == sorted([(7, a), (7, b), (8, c), (9, rows[5][1])])


def test_chain_of_copies_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    words = [f"w{i}" for i in range(400)]
    # each text shares 0.8 or more with its neighbours only
    rows = [(i, " ".join(words[20 * i : 20 * i + 200])) for i in range(10)]
    shuffled = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r.doc_id for r in near.keep_one_of_each(shuffled).collect()] == [0]
