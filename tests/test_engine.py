"""Index, matching, drivers and streams on small tables with results worked out by hand."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from orrery import registry_runs, session, storage
from orrery.functions import text as T
from orrery.operators import bm25, chunking, entity_graph, kg, metrics, ranking, vector
from orrery.plans import agent, evaluate, search
from orrery.sources import sinks
from orrery.streaming import incremental

QUOTED = [("'foo'", "Foo", "Foo", "'foo'"), ("''bar，'", "Bar", "Bar", "''bar，'"), ("don't", "Don't", "Don't", "don't"), (" 'v1.5 bm25' ", "V1.5 bm25", "Bm25", "' '"), ("'", "", "", "'")]


def test_normalisers_strip_quotes(spark):
    rows = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUOTED)], "i int, t string")
    got = rows.select("i", T.normalize_entity_graph(F.col("t")).alias("g"), T.normalize_entity_kg_query(F.col("t")).alias("q"), T.normalize_entity_kg_build(F.col("t")).alias("b")).orderBy("i").collect()
    assert [(r.g, r.q) for r in got] == [(g, q) for _, g, q, _ in QUOTED]
    assert [r.b for r in got][:3] == [b for *_, b in QUOTED][:3]
    names = spark.createDataFrame([("''",), ("'）",), ("it's",)], "n string")
    assert [r.n for r in names.filter(T.is_valid_entity(F.col("n"))).collect()] == ["it's"]


def test_tokens_keep_their_case_and_are_counted(spark):
    rows = spark.createDataFrame([("Bm25 BM25, bm25 Bm25",), ("",), (None,)], "t string")
    got = rows.select(T.tokenize(F.col("t")).alias("w"), T.counted(T.tokenize(F.col("t"))).alias("c")).collect()
    assert got[0].w == ["Bm25", "BM25", "bm25", "Bm25"] and {(x.word, x.n) for x in got[0].c} == {("Bm25", 2), ("BM25", 1), ("bm25", 1)}
    assert [r.w for r in got[1:]] == [[], []] and [r.c for r in got[1:]] == [[], []]


def test_bm25_index_is_built_once(spark):
    chunks = spark.createDataFrame([(1, "apple pear apple"), (2, "pear fig"), (3, None), (4, "")], "chunk_id long, content string")
    index = bm25.build(chunks)
    assert sorted(tuple(r) for r in index.postings.collect()) == [("apple", 1, 2, 3), ("fig", 2, 1, 2), ("pear", 1, 1, 3), ("pear", 2, 1, 2)]
    assert tuple(index.stats.first()) == (2, 2.5)
    queries = spark.createDataFrame([(1, "apple")], "query_id long, query string")
    assert bm25.search(queries, index).collect() == bm25.search(queries, chunks).collect()


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    rows = spark.createDataFrame([("x" * 1000, [1.0] * 10)] * 50, "t string, v array<double>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(session.small(rows)) and not hinted(session.small(rows, rows=10)) and not hinted(session.small(rows, most=20_000))


def test_exact_search_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "chunk_id long, vec array<double>")
    q = v.select(F.col("chunk_id").alias("query_id"), "vec").limit(20)
    want = sorted(tuple(r) for r in vector.search(q, v, 3).collect())
    monkeypatch.setattr(vector, "BLOCK", 4)
    assert sorted(tuple(r) for r in vector.search(q, v, 3).collect()) == want and len(want) == 60


def test_containment_by_brute_force(spark):
    rng = random.Random(2)
    name = lambda n: "".join(rng.choice("aAbB") for _ in range(n))
    short, long = {name(rng.randrange(1, 6)) for _ in range(40)}, {name(rng.randrange(1, 12)) for _ in range(60)} | {""}
    got = entity_graph.contained(spark.createDataFrame([(x,) for x in short], "s string"), spark.createDataFrame([(x,) for x in long], "l string")).collect()
    assert {(r.s, r.l) for r in got} == {(a, b) for a in short for b in long if a.lower() in b.lower()} and len(got) == len(set(got))


def test_likeness_by_brute_force(spark):
    rng = random.Random(3)
    nodes = {"".join(rng.choice("abcde") for _ in range(rng.randrange(4, 14))) for _ in range(80)}
    asked = set()
    for n in sorted(nodes)[:40]:
        x = list(n)
        x[rng.randrange(len(x))] = rng.choice("abcdeX")
        if rng.random() < 0.5:
            x.insert(rng.randrange(len(x)), rng.choice("abY"))
        asked.add("".join(x))
    got = {r.entity: r.node for r in entity_graph.alike(spark.createDataFrame([(a,) for a in asked], "entity string"), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    want = {}
    for a in asked:
        best = min(((-difflib.SequenceMatcher(None, a.lower(), n.lower()).ratio(), n) for n in nodes))
        if -best[0] >= 0.8:
            want[a] = best[1]
    assert got == want and len(want) > 10


def test_breadcrumb_of_repeated_sentences(spark):
    text = "# A\nSame words here. More of them now. \n# B\nSame words here. And an end."
    docs = spark.createDataFrame([("a.md", text)], "source string, text string")
    kept = lambda how: [(r.content, r.headings) for r in chunking.sliding_window(docs, 6, 0, breadcrumb=how).orderBy("chunk_index").collect()]
    assert [h for c, h in kept("running") if c.startswith("Same") or "Same words" in c] != []
    last = [h for c, h in kept("running") if c.endswith("And an end.") or c == "And an end."]
    assert last and last[0] == ["B"]


def test_graph_of_names_without_common_words(spark):
    asked = spark.createDataFrame([(1, "vector"), (2, "zz")], "query_id long, entity string")
    nodes = spark.createDataFrame([("Vector store",), ("Embedding",)], "entity string")
    assert [(r.query_id, r.node) for r in kg.match_nodes(asked, nodes).collect()] == [(1, "Vector store")]


# ------------------------------------------------------------------- drivers

TEXTS = ["alpha beta gamma Delta Epsilon", "beta gamma Delta words", "totally different thing Omega", "alpha Omega alpha", "gamma Delta rays and alpha Omega"]


@pytest.fixture(scope="module")
def world(spark):
    chunks = storage.written(spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(TEXTS)], "chunk_id long, source string, content string"), "world")
    cases = spark.createDataFrame([(1, "alpha beta", "exact", "alpha"), (2, "Omega thing", "mixed", ""), (3, "zzz 优化", "mixed", "none")], "query_id long, query string, category string, golden_answer string")
    golden = spark.createDataFrame([(1, "s0"), (2, "s2"), (2, "s4"), (3, "s1")], "query_id long, source string")
    return chunks, storage.written(cases, "cases"), golden, search.build_index(chunks, graph=True)


def test_run_evaluation(spark, world):
    chunks, cases, golden, index = world
    found = search.routes(cases.select("query_id", "query"), index)
    found["kg"] = found.pop("graph")
    scores, summary = evaluate.run_evaluation(found, cases, golden, chunks)
    rows = {r.stage: r for r in summary.collect()}
    assert set(rows) == {"bm25", "vector", "graph", "hybrid", "rrf", "cross_encoder"}
    assert scores.count() == 18 and rows["bm25"].hit == pytest.approx(2 / 3, abs=1e-4) and all(0 <= r.mrr <= 1 for r in rows.values())


def test_ablation_categories_and_sweeps(spark, world):
    chunks, cases, golden, index = world
    found = {k: storage.written(v, "route") for k, v in search.routes(cases.select("query_id", "query"), index).items()}
    got = evaluate.run_module_ablation(found, cases, golden, chunks).orderBy("ordinal").collect()
    assert [r.configuration for r in got] == ["bm25_only", "vector_only", "graph_only", "concat_naive", "rrf_fusion", "full_pipeline", "triple_fusion"]
    assert got[0].delta_mrr == 0 and all(b.delta_mrr == pytest.approx(b.mrr - a.mrr, abs=1e-4) for a, b in zip(got, got[1:], strict=False))
    by = {(r.category, r.configuration): r for r in evaluate.run_category_breakdown(found, cases, golden, chunks).collect()}
    assert len(by) == 2 * 8 and by["exact", "bm25_to_full_gain"].mrr == pytest.approx(by["exact", "full_pipeline"].mrr - by["exact", "bm25_only"].mrr)
    sweep = evaluate.quick_sweep(found, cases, golden, chunks, rrf_ks=(30, 60), ce_ks=(1, 3))
    rows = sweep.collect()
    assert len(rows) == 4 and evaluate.best_config(sweep, "rrf_k", "ce_top_k").first().mrr == max(r.mrr for r in rows)
    files = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(TEXTS)], "source string, text string")
    full = evaluate.full_sweep(files, cases, golden, sizes=(8, 16), overlaps=(2, 8)).collect()
    assert {(r.chunk_size, r.overlap) for r in full} == {(8, 2), (16, 2), (16, 8)}


def test_deep_dive_and_latency(spark, world):
    chunks, cases, golden, index = world
    found = search.routes(cases.select("query_id", "query"), index)
    rows = evaluate.query_deep_dive(found, cases, golden, chunks, [1, 99]).collect()
    assert {r.query_id for r in rows} == {1} and {r.stage for r in rows} == {"bm25", "vector", "rrf", "cross_encoder"}
    top = next(r for r in rows if r.stage == "cross_encoder" and r.rank == 1)
    assert top.relevant and top.source == "s0" and top.mrr == 1.0 and top.preview == TEXTS[0]
    stages = {r.stage for r in evaluate.latency_profile(cases, index, runs=2).collect()}
    assert stages == {"bm25_search_ms", "vector_search_ms", "graph_search_ms", "rrf_fusion_ms", "ce_rerank_ms", "total"}


def test_latency_of_all_routes_and_cases(spark, world, sf, monkeypatch):
    """The query times the graph's route as well, each case alone, and a stage's time
    is that of all its jobs, those that run while its plan is made among them."""
    chunks, cases, golden, index = world
    asked, plain = [], search.bm25.search
    monkeypatch.setattr(search.bm25, "search", lambda q, *a, **b: (time.sleep(2), asked.append(q.count()), plain(q, *a, **b))[2])
    rows = {r.stage: r for r in evaluate.latency_profile(cases, index, runs=1, batches=3).collect()}
    assert asked == [1, 1, 1] and rows["bm25_search_ms"].min_ms >= 2000
    held = {}
    monkeypatch.setattr(search, "build_index", lambda c, graph=False, triples=None: held.update(graph=graph))
    monkeypatch.setattr(evaluate, "latency_profile", lambda c, i, **how: held.update(how, n=c.count()))
    registry_runs.q_latency_profile(spark, sf)
    assert held["graph"] and held["runs"] == 1 and held["batches"] == held["n"] == 40


def test_judged_answers(spark, world):
    chunks, cases, golden, index = world
    details, summary = evaluate.run_llm_evaluation(cases, index, lambda ps: ['{"score": 0.5, "reason": "r"}' if "JSON" in p else "said" for p in ps])
    rows = {r.query_id: r for r in details.collect()}
    assert rows[1].answer == "said" and rows[1].faithfulness.score == 0.5 and rows[2].context_recall.reason == "缺少上下文或参考答案"
    assert rows[1].context.startswith("[来源1: s0] alpha beta") and {r.judge for r in summary.collect()} == {"faithfulness", "relevancy", "recall"}
    plain = {r.query_id: r.answer for r in agent.retrieve_and_generate(cases, index).collect()}
    assert plain[1].startswith("[来源: s0] alpha beta") and plain[1].count("[来源") == 2
    assert evaluate.run_quick_check(cases, index, None) is None
    assert evaluate.run_quick_check(cases, index, lambda ps: ["ok"] * len(ps), 1).count() == 1


def test_rewrites_and_calibration(spark, world):
    chunks, cases, golden, index = world
    rows = {r.query_id: r for r in evaluate.evaluate_rewrites(cases, golden, index).collect()}
    assert rows[3].rewritten_query.endswith("优化方向") and rows[1].delta_mrr == 0 and not rows[1].helpful and rows[1].ce_score_original == 10.0
    cases_ = spark.createDataFrame([(1.0, True), (1.6, True), (2.2, False), (4.0, False)], "ce_score_original double, helpful boolean")
    assert tuple(evaluate.calibrate_threshold(cases_).first()) == (2.0, 1.0, 4, "low")


def test_agent_answers_from_first_or_latest(spark, world):
    _, cases, _, index = world
    queries = cases.select("query_id", "query")
    for use, attempt in (("latest", 2), ("first", 1)):
        run = agent.run_queries(queries, index, threshold=11.0, use=use)
        assert {(r.query_id, r.attempts) for r in run.answers.collect()} == {(1, 2), (2, 2), (3, 2)}
        assert {r.attempt for r in run.chunks.collect()} == {attempt}
    with pytest.raises(ValueError):
        agent.run_queries(queries, index, use="best")


def test_knowledge_graph_diagnostics(spark):
    t = lambda *x: [dict(zip(("subject", "relation", "object"), y, strict=True)) for y in x]
    records = spark.createDataFrame([("c1", "d1", t(("Alpha", "near", "Omega"))), ("c2", "d2", t(("Omega", "near", "Delta")))], "chunk_id string, source_doc string, triples array<struct<subject:string,relation:string,object:string>>")
    chunks = spark.createDataFrame([("c1", "d1", "Alpha Omega"), ("c2", "d2", "Omega Delta")], "chunk_id string, source string, content string")
    cases = spark.createDataFrame([(1, "where is Alpha", "exact"), (2, "where is Delta", "graph"), (3, "nothing", "graph")], "query_id long, query string, category string")
    golden = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "d1"), (3, "d2")], "query_id long, source string")
    rows, summary = evaluate.kg_diagnostics(cases, golden, chunks, kg.clean_triples(records))
    got = {r.query_id: r for r in rows.collect()}
    assert got[1].hit_rank == 1 and got[1].top_sources == ["d1"] and "Alpha" in got[1].matched_nodes and got[3].hit_rank is None
    assert {(r.category, r.n, r.hit) for r in summary.collect()} == {("exact", 1, 1.0), ("graph", 2, 0.5), ("overall", 3, 0.6667)}
    clean = spark.createDataFrame([("d1",)], "source string")
    only, total = evaluate.kg_control(cases, golden, chunks, records, clean)
    assert [r.query_id for r in only.collect()] == [1] and {r.category for r in total.collect()} == {"exact", "overall"}


def test_index_is_attached_once_stored(spark, world, tmp_path):
    chunks, cases, _, _ = world
    path = str(tmp_path / "index")
    one = search.ensure_index(spark, path, chunks)
    two = search.ensure_index(spark, path, chunks.limit(0))  # not built again
    queries = cases.select("query_id", "query")
    for index in (one, two):
        assert bm25.search(queries, index.words).count() > 0 and index.entities is None
    assert set(search.stages(queries, two)) == {"bm25", "vector", "rrf", "cross_encoder"}


def test_kg_build_retries_failed_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "d", "one"), ("2", "d", "two")], "chunk_id string, source string, content string")
    path, said = str(tmp_path / "kg"), '[{"subject": "text", "relation": "is", "object": "short"}]'
    first = agent.run_kg_build(chunks, path, lambda ps: [said if "one" in p else "" for p in ps]).first()
    assert (first.total, first.pending, first.total_triples, first.failed) == (2, 0, 1, 1)
    second = agent.run_kg_build(chunks, path, lambda ps: [said] * len(ps), retry_failed=True).first()
    assert (second.total_triples, second.failed) == (2, 0)
    with pytest.raises(ValueError):
        agent.run_kg_build(chunks, path, None)


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(5)
    assert sinks.report_md("R", {"t": df}).count("\n| ") == 7 and "3 more rows are not shown" in sinks.report_md("R", {"t": df}, rows=2)
    ablation = spark.createDataFrame([("a", 0, 0.5)], "configuration string, ordinal int, mrr double")
    text = sinks.report_experiments(ablation, spark.createDataFrame([("c", "a", 0.5)], "category string, configuration string, mrr double"), spark.createDataFrame([("s", 1.0)], "stage string, mean_ms double"))
    assert "██████████░░░░░░░░░░" in text and text.index("Modules") < text.index("Categories") < text.index("Latency")


def test_ordered_dedup_and_streamed_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "b", 2)], "query_id long, value string, position int")
    assert sorted((r.position, r.value) for r in ranking.ordered_dedup(rows, "value").collect()) == [(0, "b"), (1, "a")]
    schema = "ts timestamp, event_type string, value double"
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 10:05:00' ts, 'a' event_type, 1.0D value union all select timestamp'2024-01-01 10:55:00', 'a', 2.0D union all select timestamp'2024-01-01 11:30:00', 'a', 4.0D").write.json(src)
    counts = incremental.windowed_counts(spark.readStream.schema(schema).json(src))
    run = counts.writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [(r.n, r.total) for r in spark.table("win").orderBy("start").collect()]
    assert got == [(2, 3.0)]  # the later window is still open
    assert metrics.eval_summary(spark.createDataFrame([("s", 1, 1.0, 1.0, 1.0, 1.0)], "stage string, query_id int, mrr double, hit double, precision double, recall double")).count() == 1


def test_pdf_pages():
    import zlib

    from orrery.sources import pdf

    packed = zlib.compress(b"BT /F1 12 Tf 72 700 Td (A \\(b\\) \\101) Tj 0 -14 Td [(c) -250 (d)] TJ T* <6566> Tj ET")
    data = b"%PDF-1.4\n3 0 obj<</Type /Page /Contents [4 0 R 5 0 R]>>endobj\n4 0 obj<</Filter/FlateDecode/Length 9>>stream\n" + packed + b"\nendstream endobj\n5 0 obj<</Length 1>>stream\nBT (more) Tj ET\nendstream endobj\n6 0 obj<</Type/Page>>endobj\n7 0 obj<</Type/Pages>>endobj"
    assert pdf.pages(data) == ["A (b) A\ncd\nef\nmore", ""]
    with pytest.raises(ValueError):
        pdf.pages(b"no pdf")
