import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from tickweave.llm import packing

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SLOW = Tokenizer.from_file(PATHS[0])


def want_ids(text):
    return SLOW.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_those_of_tokenizers():
    rng = random.Random(3)
    texts = ["", " ", "it's <|endoftext|> we'll", "日本語 ١٢ 🙂 x", "a\u0085b\xa0 c\x1c\x1dd  \r\n\t e", "x" * 3000]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), 32, 10, 39, rng.randrange(97, 123)])) for _ in range(200)) for _ in range(300)]
    for t in texts:
        assert packing.token_ids(t, *PATHS).tolist() == want_ids(t), repr(t)


def test_evolution_keeps_every_item_and_never_gets_worse():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1500, 400)
    first = packing._packing(rng.permutation(len(lengths)), lengths, 2048)
    out = packing.evolve(lengths, [first], 1, 2048, generations=30)
    for m in [*out, packing.crossover(rng, out[0], first, lengths, 2048)]:
        assert (m >= 0).all() and np.bincount(m, lengths).max() <= 2048
    assert packing.fitness(out[0], lengths, 2048) >= packing.fitness(first, lengths, 2048)


def islands(lengths, capacity, seed):
    """What pack() does with one block, without Spark: (bins at the best start, bins at the end)."""
    members = [packing.evolve(lengths, [], seed + i, capacity, 0) for i in range(packing.ISLANDS)]
    start = min(int(m[0].max()) + 1 for m in members)
    for epoch in range(packing.EPOCHS):
        members = [packing.evolve(lengths, m, seed + 100 * epoch + i, capacity) for i, m in enumerate(members)]
        members = [[*m[:-1], members[i - 1][0]] for i, m in enumerate(members)]
    return start, min(int(m[0].max()) + 1 for m in members)


def fewest_bins(lengths, capacity):
    items, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, loads):
        if len(loads) >= best[0]:
            return
        if k == len(items):
            best[0] = len(loads)
            return
        for load in set(loads):
            if load + items[k] <= capacity:
                rest = list(loads)
                rest[rest.index(load)] += items[k]
                place(k + 1, rest)
        place(k + 1, [*loads, items[k]])

    place(0, [])
    return best[0]


def test_small_packings_are_optimal():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(5, 60, rng.integers(1, 10))
        assert islands(lengths, 100, 1000 * seed)[1] == fewest_bins(lengths.tolist(), 100)


def plain(lengths, capacity=2048):
    return int(packing.best_fit_decreasing(lengths, capacity).max()) + 1


def test_never_worse_than_best_fit_decreasing_and_better_by_injection(monkeypatch):
    draw = np.random.default_rng(0).integers
    sets = {"even": draw(600, 1101, 3000), "wide": draw(300, 1501, 3000), "any": draw(20, 1400, 2000), "small": draw(1, 40, 500)}
    saved = {name: plain(x) - islands(x, 2048, 1)[1] for name, x in sets.items()}
    assert min(saved.values()) >= 0 and saved["even"] >= 10
    moved = []

    def nothing_injected(rng, mother, father, lengths, capacity):
        moved.append(1)
        return mother  # without an injected bin nothing is displaced

    monkeypatch.setattr(packing, "crossover", nothing_injected)
    assert islands(sets["even"], 2048, 1)[1] == plain(sets["even"])
    assert len(moved) == packing.ISLANDS * packing.EPOCHS * packing.GENERATIONS


def test_a_crossover_injects_whole_bins_and_displaces_only_what_meets_them():
    rng = np.random.default_rng(3)
    lengths = rng.integers(100, 1000, 300)
    mother, father = (packing._packing(rng.permutation(300), lengths, 2048) for _ in "ab")
    child = packing.crossover(rng, mother, father, lengths, 2048)
    groups = lambda m: {frozenset(np.flatnonzero(m == b).tolist()) for b in range(m.max() + 1)}
    well = {frozenset(np.flatnonzero(father == b).tolist()) for b in np.flatnonzero(packing._well_filled(father, lengths))}
    injected = well & groups(child)
    assert len(injected) >= len(well) / 2
    items = frozenset().union(*injected)
    # bins of mother that no injected item met are whole; best fit may have added to them
    whole = [g for g in groups(mother) if not g & items]
    assert whole and all(any(g <= c for c in groups(child)) for g in whole)


def test_packing_round_trip(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "<|endoftext|>"] + [" ".join(rng.choice(["alpha", "beta", "été", "x1"]) for _ in range(rng.choice([3, 90, 400, 3000]))) for _ in range(70)]
    rows = [(i if i != 9 else None, t, 5, "b") for i, t in enumerate(texts)] + [(4, texts[4], 5, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, block string")
    out = packing.pack(packing.materialize(packing.tokenize(df), "pieces"), block=20).collect()
    ids = {i: np.array(want_ids(t), "<u4") for i, t, *_ in rows}
    seen = {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and 1 <= r.length <= 2048
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, pieces in seen.items():
        twice = 2 if i == 4 else 1
        assert sum(p[2] for p in pieces) == len(ids[i]) * twice
        assert all(length == 2048 for piece, _, length in pieces if piece > 0)
    made = packing.ISLANDS * packing.EPOCHS * packing.GENERATIONS
    assert all((r.crossovers, r.bins_saved >= 0) == (made, True) if r.length < 2048 else (r.crossovers, r.bins_saved) == (0, 0) for r in out)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in out) // 2048) + 6
    assert packing.packed_sequences(df.limit(0)).count() == 0
