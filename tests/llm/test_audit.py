import re
from itertools import permutations

from tickweave.llm import audit

DOCS = "doc_id long, text string, source string, note string, mask int, part string"
LABELS = "doc_id long, quality int, toxic int, text string"


def brute(docs, labels):
    """The filters applied one after the other, as the contract words them."""
    out = {}
    texts = [(d, (t or ""), (s or "")) for d, t, s, *_ in docs]
    good = {d for d, q, _, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x, *_ in labels if x == 1 and d is not None}

    def fails(letter, d, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": d is not None and any(o == text and e is not None and e < d for e, o, _ in texts),
        }[letter]

    sets = [{x for x in "ABCDE" if fails(x, d, t)} for d, t, _ in texts]
    for part in {s for _, _, s in texts}:
        rows = [(d, f) for (d, _, s), f in zip(texts, sets, strict=True) if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for x in order:
                shapley[x] += sum(x in f for _, f in left)
                left = [r for r in left if x not in r[1]]
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                redundant = sum(x in f for _, f in rows) - len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, sum(f == {x} for _, f in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), shapley[x])
    return out


def got(spark, docs, labels):
    rows = audit.interaction_report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len({tuple(r)[:3] for r in rows})
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


def test_every_order_against_the_filters_themselves(spark):
    plain = " ".join(f"w{i}" for i in range(210))
    texts = [None, "", " \t\n", "short text", "SHOUT now", "one & two", plain, plain, plain + "\x0b#", plain.upper(), "same " * 300, "same " * 300, "é" * 49 + "A", "é" * 50 + "A", "\x85a\x85", "a b " * 199, "x " * 100 + plain[:400] + " $"]
    docs = [(i, t, ("web", "books", None, "")[i % 4], "n", 7, "clash") for i, t in enumerate(texts)]
    docs += [(None, plain, "web", None, 1, None), (None, "own", "web", None, 1, None), docs[6], (6, "another text of the same id", "books", None, 1, None), (-5, "same " * 300, "books", None, 1, None)]
    labels = [(i, i % 2, (i // 2) % 2, "t") for i in range(12)] + [(3, 1, None, ""), (3, 0, 0, ""), (None, 1, 1, ""), (999, 1, 1, "")]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert got(spark, [], [(1, 1, 1, "")]) == {}
    docs = [(1, "a", "s", "", 0, "")]
    assert got(spark, docs, []) == brute(docs, [])


def test_a_very_long_text(spark):
    docs = [(1, "word " * 300_000 + "X", "s", "", 0, ""), (2, " ".join(map(str, range(200_000))), None, "", 0, "")]
    assert got(spark, docs, []) == brute(docs, [])
