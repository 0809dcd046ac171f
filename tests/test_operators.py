"""Operators on small literal tables with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from orrery import registry
from orrery.functions import text as T
from orrery.operators import bm25, chunking, entity_graph, kg, metrics, ranking, rerank, vector
from orrery.plans import agent, search
from orrery.sources import files, sinks
from orrery.streaming import incremental


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_contract(spark):
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(registry.QUERIES) > 60
    assert len(__spark_entry__.entry(spark).schema) > 3


# ------------------------------------------------------------------ chunking


def test_window_bounds():
    assert chunking.window_bounds([100, 100, 100, 30, 30, 200], 256, 38) == [(0, 2), (1, 4), (2, 5), (3, 5), (4, 6)]
    assert chunking.window_bounds([300, 10], 256, 38) == [(0, 1), (1, 2)]
    assert chunking.window_bounds([], 256, 38) == []
    for counts in ([5] * 40, [300] * 3, [1, 250, 5, 251, 3]):
        got = chunking.window_bounds(counts, 256, 38)
        assert {k for i, j in got for k in range(i, j)} == set(range(len(counts)))
        assert all(sum(counts[i:j]) <= 256 or j == i + 1 for i, j in got)


def test_sliding_window(spark):
    docs = spark.createDataFrame([("a.txt", "One two. Three four! Five six? Seven."), ("b.txt", "word " * 50 + "end."), ("c.txt", ""), ("d.txt", None)], "source string, text string")
    got = chunking.sliding_window(docs, size=6, overlap=3).collect()
    own = [(r.chunk_index, r.content) for r in got if r.source == "a.txt"]
    assert own == [(0, "One two.Three four!"), (1, "Three four!Five six?"), (2, "Five six?Seven.")]
    cut = [r.content for r in got if r.source == "b.txt"]
    assert cut == [("word " * 50 + "end.")[: int(254 * 6 / 52)]]
    split = chunking.sliding_window(docs.filter("source = 'b.txt'"), size=6, overlap=0, oversize="split").agg(F.sum(F.length("content"))).first()[0]
    assert split == 254 and {r.source for r in got} == {"a.txt", "b.txt"}


def test_headings_and_breadcrumb(spark):
    text = "# A\nx\n## B\n### C\ny\n## D\n#no\n# E\n"
    row = spark.createDataFrame([(text,)], "t string").select(T.md_headings(F.col("t")).alias("h")).select("h", T.heading_breadcrumb(F.col("h"), F.lit(text.index("y"))).alias("y"), T.heading_breadcrumb(F.col("h"), F.lit(text.index("## D"))).alias("d")).first()
    assert [(h.pos, h.level, h.title) for h in row.h] == [(0, 1, "A"), (6, 2, "B"), (11, 3, "C"), (19, 2, "D"), (28, 1, "E")]
    assert row.y == ["A", "B", "C"] and row.d == ["A", "D"]


CODE = '''import os

def f(x):
    return x

class Small:
    def only(self):
        return 1

class Big:
    """Doc."""
    def a(self):
        return 1
    async def b(self):
        return 2
'''


def test_ast_chunks(spark):
    got = chunking.python_chunks(CODE)
    assert [(h, a) for _, h, a, _ in got] == [(["module-level"], 1), (["def: f"], 3), (["class: Small"], 6), (["class: Big"], 10), (["class: Big", "def: a"], 12), (["class: Big", "def: b"], 14)]
    assert got[3][0] == 'class Big:\n    """Doc."""' and got[2][0].endswith("return 1")
    assert chunking.python_chunks("def broken(:\n x") == [("def broken(:\n x", [], 1, 2)]
    big = "def g():\n" + "\n".join(f"    a{i} = {i} + {i}" for i in range(40))
    parts = chunking.python_chunks(big, 40)
    assert len(parts) > 1 and "\n".join(p[0] for p in parts) == big
    out = chunking.process_documents(spark.createDataFrame([("m.py", CODE), ("n.md", "# T\nBody one. Two."), ("o.txt", " ")], "source string, text string")).collect()
    assert {r.source_type for r in out} == {"ast", "markdown"} and all(len(r.chunk_id) == 8 for r in out)
    assert [r.heading_breadcrumb for r in out if r.source == "n.md"] == ["T"]


def test_chunk_id(spark):
    assert spark.range(1).select(T.chunk_id(F.lit("rag-intro.md"), F.lit(0))).first()[0] == "601d8f4d"


# --------------------------------------------------------------------- texts


def test_entities_and_scores(spark):
    one = spark.range(1)
    assert one.select(T.normalize_entity_graph(F.lit(" ，bert。"))).first()[0] == "Bert"
    assert one.select(T.normalize_entity_kg_query(F.lit("（bge--m3  v1.5）"))).first()[0] == "Bge-m3"
    names = spark.createDataFrame([("a",), ("的",), ("12.5",), ("##",), ("BM25",), ("，。",)], "n string")
    assert [r.n for r in names.filter(T.is_valid_entity(F.col("n"))).collect()] == ["BM25"]
    raw = spark.createDataFrame([('```json\n{"score": 1.7, "reason": "r"}\n```',), ('```\n{"score": 0.5}\n```',), ('{"score": -1}',), ("text",), ('{"reason": "x"}',)], "raw string")
    assert [tuple(r.s) for r in raw.select(T.parse_judge_score(F.col("raw")).alias("s")).collect()] == [(1.0, "r"), (0.5, ""), (0.0, ""), (0.0, "解析失败: text"), (0.0, "x")]


# ----------------------------------------------------------------- retrieval


def test_bm25(spark):
    texts = ["apple banana apple", "apple cherry", "apple date egg fig", "grape", "", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "apple banana banana"), (2, ""), (3, "zzz")], "query_id long, query string")
    docs = [t.split() for t in texts if t]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    terms = {w for d in docs for w in d}
    raw = {w: math.log(n - sum(w in d for d in docs) + 0.5) - math.log(sum(w in d for d in docs) + 0.5) for w in terms}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}

    def score(d):
        return sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in ("apple", "banana", "banana"))

    want = sorted(((round(score(d), 6), i) for i, d in enumerate(docs) if score(d) > 0), key=lambda x: (-x[0], x[1]))
    got = bm25.search(queries, chunks).orderBy("rank").collect()
    assert [(r.score, r.chunk_id) for r in got] == want and {r.query_id for r in got} == {1}
    assert bm25.search(queries, chunks.limit(0)).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.6, 0.8, 0.0]), (4, [0.6, 0.8, 0.0])], "chunk_id long, vec array<float>")
    q = spark.createDataFrame([(9, [0.0, 1.0, 0.0])], "query_id long, vec array<float>")
    assert [(r.chunk_id, r.score) for r in vector.search(q, v, 3).orderBy("rank").collect()] == [(2, 1.0), (3, 0.8), (4, 0.8)]
    assert vector.search_lsh(q, v, 3, radius=2.0).first().chunk_id == 2


def test_lsh_recall_of_the_registered_query(spark, sf):
    from orrery import registry

    for d in (sf, sf.replace("sf0.001", "sf0.01")):
        want, got = ({(r.query_id, r.chunk_id) for r in registry.QUERIES[q](spark, d).collect()} for q in ("vector_search", "vector_search_lsh"))
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


RANKS = [(1, "a", "bm25", 1, 5.0), (1, "b", "bm25", 2, 3.0), (1, "b", "vector", 1, 0.9), (1, "c", "vector", 2, 0.4)]


def ranks(spark):
    return spark.createDataFrame(RANKS, "query_id long, chunk_id string, route string, rank int, score double")


def test_fusion(spark):
    got = ranking.rrf(ranks(spark)).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.original_source) for r in got] == [("b", round(1 / 62 + 1 / 61, 6), "bm25"), ("a", round(1 / 61, 6), "bm25"), ("c", round(1 / 62, 6), "vector")]
    weighted = ranking.rrf(ranks(spark), {"vector": 0.0, "graph": 9.0}).orderBy("rank").collect()
    assert [r.chunk_id for r in weighted] == ["a", "b", "c"]
    both = ranking.route_overlap(ranks(spark).filter("route = 'bm25'"), ranks(spark).filter("route = 'vector'")).first()
    assert (both.n_both, both.n_either) == (1, 3)
    flat = {(r.chunk_id, r.route): r.score for r in ranking.minmax_normalize(ranks(spark)).collect()}
    assert flat[("a", "bm25")] == 1.0 and flat[("c", "vector")] == 0.0
    assert ranking.minmax_normalize(ranks(spark).filter("chunk_id = 'a'")).first().score == 5.0
    assert [r.chunk_id for r in ranking.dedup_concat(ranks(spark)).orderBy("rank").collect()] == ["a", "b", "c"]


def test_rerank_with_injected_scorer(spark):
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id long, query string")
    chunks = spark.createDataFrame([("a", "s", "alpha"), ("b", "s", "beta alpha"), ("c", "s", "none")], "chunk_id string, source string, content string")
    fused = ranking.rrf(ranks(spark))
    assert [(r.chunk_id, r.score) for r in rerank.rerank(fused, queries, chunks).orderBy("rank").collect()] == [("b", 10.0), ("a", 5.0), ("c", 0.0)]
    mine = rerank.rerank(fused, queries, chunks, 1, scorer=lambda q, t: [float(len(x)) * (x != "beta alpha") for x in t]).collect()
    assert [(r.chunk_id, r.rank) for r in mine] == [("a", 1)]
    said = agent.generate_answer(rerank.rerank(fused, queries, chunks), queries.unionByName(spark.createDataFrame([(2, "x")], queries.schema)), chunks)
    head = "[本地 LLM 未连接] 基于检索结果 (共 1 次检索, Top-3 结果):\n\n"
    parts = [f"--- 来源 {i}: s | CE Score: {x} ---\n{t}\n\n" for i, x, t in ((1, "10.0000", "beta alpha"), (2, "5.0000", "alpha"), (3, "0.0000", "none"))]
    assert dict(tuple(r) for r in said.collect()) == {1: head + "".join(parts), 2: agent.NO_RESULT}


# --------------------------------------------------------------------- graphs


def test_entity_graph(spark):
    ec = spark.createDataFrame([(1, "A", 1.0), (1, "B", 0.5), (2, "B", 1.0), (2, "C", 1.0), (3, "D", 2.0)], "chunk_id long, entity string, weight double")
    edges = entity_graph.cooccurrence(ec)
    assert rows(edges, "a", "b", "weight") == [("A", "B", 1), ("B", "C", 1)]
    seeds = spark.createDataFrame([(7, "A"), (7, "D")], "query_id long, entity string")
    assert rows(entity_graph.khop(seeds, edges, 2), "entity", "hop") == [("A", 0), ("B", 1), ("C", 2), ("D", 0)]
    scored = entity_graph.score_graph_chunks(entity_graph.khop(seeds, edges, 1), ec)
    assert rows(scored, "chunk_id", "score") == [(1, 0.625), (2, 0.25), (3, 1.0)]


def test_map_entities(spark):
    nodes = spark.createDataFrame([("Retrieval",), ("Vector store",), ("Embedding",)], "entity string")
    asked = spark.createDataFrame([(1, "Retrieval"), (1, "vector"), (1, "Embeding"), (1, "Zz")], "query_id long, entity string")
    got = entity_graph.map_entities(asked, nodes)
    assert rows(got, "entity", "node", "level") == [("Embeding", "Embedding", "fuzzy"), ("Retrieval", "Retrieval", "exact"), ("vector", "Vector store", "substr")]
    assert entity_graph.route_multi_entity(got).first().n_entities == 3


def test_kg(spark):
    t = lambda *x: [dict(zip(("subject", "relation", "object"), y, strict=True)) for y in x]
    data = [("c1", "d1", t(("aa", "is", "bb"), ("aa", "has", "bb"), ("aa", " ", "bb"), ("aa", "12", "bb"), ("x", "is", "bb"))), ("c2", "d1", t(("bb", "is", "cc"), ("bb", "r" * 25, "dd"), (None, "is", "dd"))), ("lost", "d2", t(("dd", "to", "cc")))]
    records = spark.createDataFrame(data, files.TRIPLES)
    triples = kg.clean_triples(records)
    assert rows(triples, "subject", "relation", "object") == [("Aa", "has", "Bb"), ("Aa", "is", "Bb"), ("Bb", "is", "Cc"), ("Bb", "r" * 20, "Dd"), ("Dd", "to", "Cc")]
    graph = kg.edges(triples)
    assert graph.filter("subject = 'Aa'").first().relations == ["has", "is"]
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d1"), ("e1", "d2"), ("e2", "d2")], "chunk_id string, source string")
    assert rows(kg.entity_chunk_index(triples, chunks).filter("entity = 'Cc'"), "chunk_id") == [("c2",), ("e1",), ("e2",)]
    matched = spark.createDataFrame([(1, "Aa"), (1, "Cc")], "query_id long, node string")
    found = kg.paths(matched, graph)
    assert rows(found, "source", "target", "mid") == [("Aa", "Cc", "Bb")]
    assert rows(kg.relevant_entities(matched, found), "entity", "weight") == [("Aa", 1.0), ("Bb", 0.5), ("Cc", 1.0)]
    assert rows(kg.pending_chunks(chunks, records), "chunk_id") == [("e1",), ("e2",)]


# -------------------------------------------------------------------- metrics


def test_metrics(spark):
    results = spark.createDataFrame([("s", 1, 1, "g"), ("s", 1, 2, "x"), ("s", 2, 1, "x"), ("s", 2, 2, "x"), ("s", 2, 3, "h"), ("s", 3, 1, "x")], "stage string, query_id long, rank int, source string")
    golden = spark.createDataFrame([(1, "g"), (2, "h"), (2, "i"), (3, "z"), (4, "g")], "query_id long, source string")
    queries = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "query_id long")
    stages = spark.createDataFrame([("s", 1)], "stage string, ordinal int")
    got = {r.query_id: (r.mrr, r.hit, r.precision, r.recall) for r in metrics.per_query(results, golden, stages, queries).collect()}
    assert got == {1: (1.0, 1.0, 0.5, 1.0), 2: (pytest.approx(1 / 3), 1.0, pytest.approx(1 / 3), 0.5), 3: (0.0, 0.0, 0.0, 0.0), 4: (0.0,) * 4, 5: (0.0,) * 4}


def test_calibration(spark):
    cases = spark.createDataFrame([(1.0, True), (1.6, True), (2.2, False), (4.0, False)], "score double, helpful boolean")
    steps = spark.createDataFrame([(x,) for x in (1.0, 1.5, 2.0, 2.1, 3.0)], "threshold double")
    assert tuple(metrics.calibrated(metrics.confusion_sweep(cases, steps), 3.0).first()) == (2.0, 1.0)
    none = spark.createDataFrame([(9.0, True)], cases.schema)
    assert tuple(metrics.calibrated(metrics.confusion_sweep(none, steps), 3.0).first()) == (3.0, 0.0)


# ----------------------------------------------------------- files and models


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("中文。".encode("gbk"))
    (tmp_path / "a.md").write_bytes(b"# T\r\nx\ry")
    (tmp_path / "c.bin").write_bytes(b"no")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.md").write_text("deep")
    got = files.load_documents(files.scan_directory(spark, str(tmp_path)), pdf=lambda data: ["p1", "p2"]).collect()
    assert {r.source: (r.encoding, r.text) for r in got} == {"a.md": ("utf-8", "# T\nx\ny"), "b.txt": ("gbk", "中文。"), "d.pdf": (None, "p1\n\np2")}
    with pytest.raises(ValueError):
        files.load_document(spark, str(tmp_path / "c.bin"))
    with pytest.raises(ValueError):
        files.resolve_split("dev")
    assert files.detect_encoding(b"\xff\xff\xff") == "latin-1" and files.load_if_exists(spark, str(tmp_path / "none")) is None


def test_sinks_and_increments(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([("a", 1)], "k string, v long").write.json(src)
    step = lambda df: df.selectExpr("k", "v * 2 as v")
    for _ in range(2):
        incremental.incremental(spark, src, "k string, v long", out, check, step)
    sinks.sink_append_jsonl(spark.createDataFrame([("b", 2)], "k string, v long"), src)
    incremental.incremental(spark, src, "k string, v long", out, check, step)
    assert rows(spark.read.parquet(out), "k", "v") == [("a", 2), ("b", 4)]
    sinks.sink_run(spark.range(2), str(tmp_path / "runs"), "r1", "p")
    sinks.sink_run(spark.range(3), str(tmp_path / "runs"), "r1", "p")
    sinks.sink_run(spark.range(1), str(tmp_path / "runs"), "r2", "p")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4
    assert "| id |" in sinks.report_md("R", {"t": spark.range(1)}) and sinks.bar(0.5, 4) == "██░░"
    (tmp_path / "t.jsonl").write_text('{"chunk_id": "1", "source_doc": "d", "triples": []}\n\nnot json\n')
    assert files.scan_triples(spark, str(tmp_path / "t.jsonl")).filter("chunk_id is not null").count() == 1


def test_models(spark):
    chunks = spark.createDataFrame([("1", "d", "text"), ("2", "d", "more")], "chunk_id string, source string, content string")
    answer = '```json\n[{"subject": "bge v1.5", "relation": " is ", "object": "model"}, {"subject": "", "relation": "x", "object": "y"}]\n```'
    got = agent.build_knowledge_graph(chunks, chunks.filter("chunk_id = '2'"), lambda prompts: [answer] * len(prompts)).collect()
    assert [(r.chunk_id, [tuple(t) for t in r.triples]) for r in got] == [("1", [("bge", "is", "model")])]

    def broken(prompts):
        raise RuntimeError("down")

    assert agent.call_model(chunks, "content", "said", broken, attempts=1).filter("said = ''").count() == 2
    judged = agent.judge(spark.createDataFrame([("q", "a"), ("q", "")], "query string, answer string"), "relevancy", lambda p: ['{"score": 0.4, "reason": "ok"}'] * len(p)).collect()
    assert [r.relevancy.score for r in judged] == [0.4, 0.0]


def test_agent_and_graph_search(spark):
    texts = ["alpha beta gamma Delta Epsilon", "beta gamma Delta words", "totally different thing Omega", "alpha Omega"]
    chunks = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "chunk_id long, source string, content string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "zzz 优化")], "query_id long, query string")
    index = search.build_index(chunks, graph=True)
    log = agent.agent_loop(queries, index, threshold=3.0).orderBy("query_id", "attempt").collect()
    assert [(r.query_id, r.attempt) for r in log] == [(1, 1), (2, 1), (2, 2)] and log[-1].query.endswith("优化方向")
    found = search.search_knowledge(queries, index, 2).filter("query_id = 1").orderBy("rank").collect()
    assert found[0].chunk_id == 0 and found[0].ce_score == 10.0


def test_paths_of_any_bound_by_brute_force(spark):
    import random
    from itertools import pairwise

    rng = random.Random(4)
    nodes = [f"n{i:02}" for i in range(25)]
    links = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)} | {(f"c{i}", f"c{i + 1}") for i in range(6)}
    graph = spark.createDataFrame([(a, b, ["r"]) for a, b in links], "subject string, object string, relations array<string>")
    asked = [(1, n) for n in nodes[:8]] + [(2, "c0"), (2, "c3"), (2, "c5"), (2, "c6"), (3, "c0")]
    matched = spark.createDataFrame(asked, "query_id long, node string")

    def shortest(a, b):
        paths = [(a,)]
        for _ in range(6):
            hit = sorted(p for p in paths if p[-1] == b and len(p) > 1)
            if hit:
                return hit[0]
            paths = [p + (y,) for p in paths for x, y in links if x == p[-1] and y not in p]
        return next(iter(sorted(p for p in paths if p[-1] == b and len(p) > 1)), None)

    for bound in (1, 2, 3, 5, 6):
        got = {(r.query_id, r.source, r.target): tuple(r.inner) for r in kg.paths(matched, graph, bound).collect()}
        want = {}
        for q, a in asked:
            for p, b in asked:
                if q == p and a != b and (found := shortest(a, b)) and len(found) - 1 <= bound:
                    assert all(step in links for step in pairwise(found))
                    want[q, a, b] = found[1:-1]
        assert got == want
    assert kg.paths(matched, graph, 0).count() == 0


def test_a_prompt_that_fails_costs_no_other_its_answer(spark):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "id long, prompt string").coalesce(1)

    def model(prompts):
        if "p7" in prompts or "p31" in prompts:
            raise RuntimeError("bad prompt")
        return [p.upper() for p in prompts]

    got = {r.id: (r.said, r.lost) for r in agent.call_model(rows, "prompt", "said", model, attempts=1, failed="lost").collect()}
    assert {i for i, (_, lost) in got.items() if lost} == {7, 31} and all(got[i] == (f"P{i}", False) for i in got if i not in (7, 31))
    short = agent.call_model(rows.limit(3), "prompt", "said", lambda p: ["x"] * min(len(p), 1), attempts=1)
    assert [r.said for r in short.collect()] == ["x"] * 3  # too few answers fail, too


def test_a_chunk_whose_call_failed_is_taken_up_again(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "d", "one"), ("2", "d", "two")], "chunk_id string, source string, content string")
    said = '[{"subject": "text", "relation": "is", "object": "short"}]'

    def down(prompts):
        if any("two" in p for p in prompts):
            raise RuntimeError("down")
        return [said] * len(prompts)

    path = str(tmp_path / "kg")
    first = agent.run_kg_build(chunks, path, down).first()
    assert (first.pending, first.failed, first.total_triples) == (1, 0, 1)
    second = agent.run_kg_build(chunks, path, lambda p: [said] * len(p)).first()
    assert (second.pending, second.total_triples) == (0, 2)


def test_rewrites_are_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(prompts):
        import uuid

        if "改写" in prompts[0]:
            for _ in prompts:
                (calls / uuid.uuid4().hex).write_text("")
            return [f"zzz {uuid.uuid4().hex[:6]}" for _ in prompts]  # another answer each time
        return [""] * len(prompts)

    chunks = spark.createDataFrame([(1, "s", "alpha beta"), (2, "s", "gamma")], "chunk_id long, source string, content string")
    queries = spark.createDataFrame([(1, "nothing"), (2, "none")], "query_id long, query string")
    run = agent.run_queries(queries, search.build_index(chunks), threshold=3.0, model=model)
    asked = sorted((r.query_id, r.query) for r in run.log.filter("attempt = 2").collect())
    assert len(list(calls.iterdir())) == 2 and len(asked) == 2
    assert asked == sorted((r.query_id, r.query) for r in run.log.filter("attempt = 2").collect())


def test_names_are_looked_up_by_few_keys(spark, sf):
    """The prefix-filtered join of names: no key is held by a large share of them."""
    from orrery import registry

    held = registry._tfidf(spark, sf).select(F.col("entity").alias("node")).distinct().filter("length(node) >= 4").withColumn("low_node", F.lower("node"))
    index = entity_graph.fuzzy_index(held)
    n, hot = held.count(), index.groupBy("pair", "length", "place").count().agg(F.max("count")).first()[0]
    every = entity_graph.pair_uses(held).agg(F.max("uses")).first()[0]
    assert n > 1000 and hot < 0.1 * n and hot < every / 3
