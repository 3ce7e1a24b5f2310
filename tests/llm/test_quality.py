import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tickweave.llm import quality


def brute_grams(text):
    """Keys of all n-grams of a text, by a loop over tokens."""
    look = lambda c: 0 if chr(c).isdigit() and c < 128 else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if c >= 128 else 4
    raw = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+", (text or "").encode())
    shape = [look(t[0]) * 4 + look(t[-1]) if look(t[0]) < 4 else 16 + t[0] for t in raw]
    out = [("token", t) for t in raw] + [("pair", a, b) for a, b in zip(raw, raw[1:])] + [("shape", a, b) for a, b in zip(shape, shape[1:])]
    return out + [("again", k) for k in (1, 2) for a, b in zip(raw, raw[k:]) if a == b]


def test_places_are_those_of_hashed_ngrams():
    texts = [None, "", "one", "one two", "a b, c!! a b", "é X2" * 5 + " é X2 X2 é", "AB ab Ab aB 1a a1 !!! !?"] + ["the the of the of !!"] * 2
    docs = []
    for places, bounds in quality._places(pa.array(texts)):
        docs += [sorted(places[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(d) for d in docs] == [len(brute_grams(t)) for t in texts]
    for i in range(len(texts)):  # equal texts give equal places; the number of distinct places is that of distinct keys
        assert len(set(docs[i])) == len(set(brute_grams(texts[i])))
    assert docs[-1] == docs[-2]


def made(spark, n=900):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = i % 5 > 0
        text = " ".join(rng.choice("the of and to with blein ation".split() if good else ["WIN!!", "Edor", "###", "the"]) for _ in range(rng.randrange(5, 60)))
        docs.append((i, text, "en", good))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score boolean"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_labels_unused_where_held_out(spark):
    docs, labels = made(spark)
    out = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(out) == 900 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert np.mean([(i % 5 > 0) == out[i].predicted for i in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) for r in out.values())
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}
    assert all(again[i] == r.score for i, r in out.items())
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in out.items() if r.predicted)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (7, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.quality_scores(docs, none).collect()] == [0.5] * 4
    assert quality.quality_scores(docs.limit(0), none).count() == 0


def test_learning_equals_a_scalar_loop():
    rng = np.random.default_rng(6)
    model, z, n, bias = quality.FtrlLogistic(50), [0.0] * 50, [0.0] * 50, [0.0, 0.0]

    def weight(zi, ni, l1, l2):
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((quality.BETA + math.sqrt(ni)) / quality.ALPHA + l2)

    for _ in range(300):
        at = np.sort(rng.choice(50, 8, replace=False))
        value, label = rng.random(8), int(at.sum() % 2)
        model.learn(at, value, label)
        w, b = [weight(z[i], n[i], quality.L1, quality.L2) for i in at], weight(*bias, 0.0, 0.0)
        error = 1 / (1 + math.exp(-(sum(x * y for x, y in zip(w, value)) + b))) - label
        for i, x, wi in zip(at, value, w):
            g = error * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * wi
            n[i] += g * g
        bias = [bias[0] + error - (math.sqrt(bias[1] + error**2) - math.sqrt(bias[1])) / quality.ALPHA * b, bias[1] + error**2]
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and np.allclose(model.bias, bias)
    packed = np.frombuffer(model.packed(), "<f4")
    assert np.allclose(packed[:-1], [weight(a, b, quality.L1, quality.L2) for a, b in zip(z, n)], atol=1e-6)
    assert quality.L1 > 0 and (quality.FtrlLogistic.weights(np.array([quality.L1, -quality.L1 / 2]), np.ones(2)) == 0).all()


def test_texts_under_one_id_are_chosen_alike(spark):
    docs, labels = made(spark, 200)
    more = docs.unionByName(docs.withColumn("text", F.reverse("text")))
    a, b = (quality.train_quality(x, labels) for x in (more.repartition(3), more.orderBy("text")))
    assert (a == b).all() and a.any()
