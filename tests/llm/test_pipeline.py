import random

import corpus_pipeline
from tickweave.llm.common import materialize


def made(spark, folder):
    rng = random.Random(11)
    word = lambda: rng.choice("the of and to with blein ation ou ent re st er".split()) + rng.choice(["", "a", "ing", "ed"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(30) for _ in range(5)]
    passage = text(60)
    docs = [(i, text(rng.randrange(80, 300))) for i in range(120)]
    junk = [(200 + i, " ".join(rng.choice(["WIN!!", "###", "$$$ buy"]) for _ in range(60))) for i in range(60)]
    copies = [(400 + i, docs[i][1]) for i in range(10)]
    leaks = [(500 + i, text(40) + " " + items[i] + " " + text(40)) for i in range(5)]
    shared = [(600 + i, f"{text(70)} {passage} {text(70)}") for i in range(3)]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs + junk + copies + leaks + shared]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200 or i >= 400), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, junk, copies, leaks, shared, passage


def test_stages_take_effect_and_agree_with_run(spark, tmp_path):
    docs, junk, copies, leaks, shared, passage = made(spark, f"{tmp_path}/sf")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/sf/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, f"{tmp_path}/sf"), name)
        seen[name] = now.collect()
        assert name == "packing" or now.columns == columns
    ids = lambda name: {r.doc_id for r in seen[name]}
    clean = {i for i, _ in docs}
    assert ids("quality") == clean | {i for part in (copies, leaks, shared) for i, _ in part}
    assert ids("near_dedup") == ids("quality") - {i for i, _ in copies}
    by_id = {r.doc_id: r for r in seen["passage_dedup"]}
    before = {r.doc_id: r.text for r in seen["near_dedup"]}
    assert set(by_id) == set(before)
    for i, r in by_id.items():
        assert r.n_chars == len(r.text)
        lost = len(before[i].split()) - len(r.text.split())
        assert (passage not in r.text and 60 <= lost <= 63) if i >= 600 else r.text == before[i]  # neighbours may agree by chance
    assert ids("decontamination") == ids("passage_dedup") - {i for i, _ in leaks}
    assert ids("packing") == ids("decontamination")
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, f"{tmp_path}/sf").collect())) == sorted(map(key, seen["packing"]))
