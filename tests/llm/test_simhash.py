import random

import xxhash
from tickweave.llm import simhash


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, tau=3):
    ids = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= tau:
                a, b = ids[i], ids[j]
                ids = [min(a, b) if x in (a, b) else x for x in ids]
    return ids


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "One TWO", "É a b c\td", "a a a a a", "x" * 5000, " ".join(rng.choice("ab cd É ef".split()) for _ in range(40_000))]
    texts += [" ".join(rng.choice(["the", "Of", "and", "zz"]) for _ in range(rng.randrange(30))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_print(t)


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(2)
    centre, prints = [rng.getrandbits(64) for _ in range(6)], set()
    for c in centre:
        for _ in range(60):
            x = c
            for _ in range(rng.randrange(0, 7)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from tickweave.llm.graph import connected_components

    for tau in (0, 1, 3, 5):
        links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), tau)
        roots = {r.node: r.root for r in connected_components(links).collect()}
        want, groups, mine = brute_components(prints, tau), {}, {}
        for s, w in zip(signed, want):
            groups.setdefault(w, set()).add(s)
            mine.setdefault(roots.get(s, s), set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_classes_cover_nulls_ties_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1, 2), (3, text, 1, 2), (3, text, 1, 2), (9, None, 1, 2), (8, "", 1, 2), (7, "quite other words here", 1, 2), (None, text, 1, 2), (None, "alone in the world", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component int")
    out = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicate_classes(df).collect()), key=str)
    assert len(out) == len(rows) and {r[2] for r in out if r[1] == f"{brute_print(text):016x}"} == {3}
    assert {r[2] for r in out if r[0] in (8, 9)} == {8} and all(r[1] == "0" * 16 for r in out if r[0] in (8, 9))
    assert [r[2] for r in out if r[1] == f"{brute_print('alone in the world'):016x}"] == [None]
    assert simhash.near_duplicate_classes(df.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 7, 8]
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["alone in the world"]
