"""The stages against brute force on the smallest tables."""

import corpus_pipeline
from orrery.llm import common, decontaminate, rans, toxicity


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns, seen = docs.columns, {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), "test-stage")
        seen[name] = docs
        assert docs.columns == (columns if name != "rans" else ["doc_id", "start", "n_tokens", "ids_crc32"])
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    scores = {r.doc_id: r.score for r in toxicity.scored(seen["input"], common.table(spark, sf, "labels"), ["doc_id"]).collect()}
    assert ids["toxicity"] == {d for d, s in scores.items() if s < toxicity.THRESHOLD}
    texts = [r.text for r in seen["simhash"].collect()]
    assert len(texts) == len(set(texts)) and ids["simhash"] <= ids["toxicity"]
    hit = {r.doc_id for r in decontaminate.matches(seen["simhash"], common.table(spark, sf, "benchmark"), ["doc_id"]).collect()}
    assert hit and ids["decontaminate"] == ids["simhash"] - hit
    items = [" ".join(r.text.lower().split()) for r in common.table(spark, sf, "benchmark").collect()]
    assert not any(x in " ".join(r.text.lower().split()) for r in seen["decontaminate"].collect() for x in items)
    assert ids["mixing"] <= ids["decontaminate"] and seen["rans"].count() == seen["mixing"].count()
    want = {(r.doc_id, r.ids_crc32) for r in rans.round_trip(seen["mixing"]).collect()}
    assert {(r.doc_id, r.ids_crc32) for r in docs.collect()} == want


def test_run_has_the_last_stage_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, tie string, edits int, item_id long, words int, fp string, component long"


def test_stages_take_nulls_repeats_and_clashing_names(spark, sf):
    bench = common.table(spark, sf, "benchmark").first().text
    long = "".join(f"word{i} " for i in range(30_000))
    texts = [(1, None), (2, ""), (3, "the same text in two rows of one id, word for word"), (3, "the same text in two rows of one id, word for word"), (3, "another text under that id, which shares no shingle with it"), (None, "a text that has no id at all but goes on for some words"), (7, long), (8, long + "end"), (9, f"before it {bench} after it")]
    rows = [(i, t, None, "s" if k % 2 else None, 0, 0.5, 1, "t", 2, 3, 4, "f", 5) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASH)
    want = {"toxicity": 9, "simhash": 6, "decontaminate": 5}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == (docs.columns if name != "rans" else ["doc_id", "start", "n_tokens", "ids_crc32"])
        out = common.written(out, "test-odd")
        if name in want:  # 1 and 2 have equal texts, 7 and 8 similar ones
            assert out.count() == want[name]
            assert name != "simhash" or sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3, 3, 7, 9]
        docs = out if name != "rans" else docs
    assert all(r.source in (None, "s") and r.edits == 2 and r.fp == "f" for r in docs.collect())


def test_stages_take_empty_tables(spark, sf):
    docs = common.table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
