import random
import re
import time
import tracemalloc

import pyarrow as pa

from tickweave.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_tiles(a, b, least):
    ua, ub, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and ua[i + n] and ub[j + n]:
                    n += 1
                if (n, -i, -j) > (best[0], -best[1], -best[2]):
                    best = (n, i, j)
        if best[0] < least:
            return sorted((i, j, n) for n, i, j in out)
        out.append(best)
        n, i, j = best
        ua[i : i + n] = [False] * n
        ub[j : j + n] = [False] * n


def test_leaks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "of", "Été", "x", "qu"]) + rng.choice(["", "1", "z"])
    items = [" ".join(word() for _ in range(rng.choice([3, 15, 24, 40]))) for _ in range(20)] + [None, "", "d d d d d d d d d d"]
    texts = [None, "", "short"]
    for _ in range(60):
        out = [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            piece = (rng.choice(items[:20])).split()
            cut = rng.randrange(len(piece))
            piece = rng.choice([piece, piece[cut:] + piece[:cut], piece[: len(piece) * 2 // 3]])
            out += [w.upper() + rng.choice(["", ","]) for w in piece] + [word() for _ in range(rng.randrange(20))]
        texts.append(" ".join(out))
    texts.append("d " * 23)
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_covered, [tuple(t) for t in r.tiles]) for r in decontaminate.benchmark_leaks(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, b in enumerate(items):
            x, y = words(t), words(b)
            tiled = brute_tiles(x, y, min(5, len(y))) if y else []
            if tiled and sum(n for *_, n in tiled) >= 0.5 * len(y):
                want[d, i] = (sum(n for *_, n in tiled), tiled)
    assert got == want and len(want) > 20
    left = decontaminate.drop_leaked(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.leak_report(docs, bench.limit(0)).count() == decontaminate.leak_report(docs.limit(0), bench).count() == 0


def test_short_items_must_stand_whole(spark):
    docs = spark.createDataFrame([(1, "Now: what is TWO plus, two?"), (2, "what is two minus plus"), (3, "plus"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "What is two plus"), (8, "minus"), (9, "-"), (10, "two minus")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.leak_report(docs, bench).collect())
    assert got == [(1, 7, 4, 4, 1.0, 1), (2, 8, 1, 1, 1.0, 1), (2, 10, 2, 2, 1.0, 1)]


def leaks_of(text, item):
    (chunk,) = decontaminate.tokens(pa.array([text]), decontaminate.ALNUM, decontaminate._VALUES)
    return [x for items in decontaminate._items([{"item_id": 1, "text": item}], 5) for x in decontaminate._leaks(chunk, items, 0.5)]


def test_one_word_over_and_over_takes_little():
    tracemalloc.start()
    start = time.time()
    ((_, _, found),) = leaks_of("a " * 20_000, "a " * 1_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 1000)] and peak < 200e6 and time.time() - start < 60


def test_matches_do_not_depend_on_the_pieces_they_come_in(monkeypatch):
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randrange(5, 40))]
        text = [rng.choice("ab") for _ in range(60)] + item[7:] + item[:9]
        found = []
        for pairs in (1, 7, 1 << 18):
            monkeypatch.setattr(decontaminate, "PAIRS", pairs)
            found.append([sorted(t) for _, _, t in leaks_of(" ".join(text), " ".join(item))])
        assert found[0] == found[1] == found[2]
        tiled = brute_tiles(text, item, 5)
        assert found[0] == ([tiled] if sum(n for *_, n in tiled) >= 0.5 * len(item) else [])
