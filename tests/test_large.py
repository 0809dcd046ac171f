"""What keeps large tables in bounds: nothing but what is needed leaves a task."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orrery import storage
from orrery.functions.batches import pieces
from orrery.operators import bm25, ivf, kg, segment, vector


def test_lsh_pairs_are_no_rows(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSHModel

    def joined(*args, **kwargs):
        raise AssertionError("pairs of a bucket are joined")

    monkeypatch.setattr(BucketedRandomProjectionLSHModel, "approxSimilarityJoin", joined)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    m /= np.sqrt((m * m).sum(1))[:, None]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "chunk_id int, vec array<double>")
    q = v.filter("chunk_id % 30 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in vector.search_lsh(q, v, 5, length=4.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    for i, rows in got.items():
        assert [c for _, c in sorted(rows)] == np.lexsort((np.arange(300), -np.round(m @ m[i], 6)))[:5].tolist()
    assert len(got) == 10
    near = vector.search_lsh(q, v, 3, length=4.0, radius=1e-6).filter("rank = 1")
    assert near.filter(F.col("query_id") == F.col("chunk_id")).count() == 10  # too few candidates: searched exactly


def test_the_best_rows_of_a_product():
    rng = np.random.default_rng(2)
    sims = np.round(rng.random((6, 40)), 1)
    sims[rng.random(sims.shape) < 0.2] = -np.inf
    sims[5] = -np.inf
    query, row = vector.best(sims, 7)
    want = [(i, j) for i in range(6) for j in sorted((j for j in range(40) if sims[i, j] > -np.inf), key=lambda j: (-sims[i, j], j))[:7]]
    assert list(zip(query.tolist(), row.tolist())) == want


def test_pieces_hold_a_bounded_number_of_words(spark):
    lists = [["a"] * n for n in (3, 0, 2, 9, 1, 1, 1, 0)]
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "w": pa.array(lists, pa.list_(pa.string()))})
    got = list(pieces([batch.slice(1), batch.slice(0, 0)], 1, most=3))
    assert [b["i"].to_pylist() for b in got] == [[1, 2], [3], [4, 5, 6, 7]]
    assert [len(b["w"].flatten()) for b in got] == [2, 9, 3]
    texts = spark.createDataFrame([(i, "one two two " * 400) for i in range(400)], "chunk_id int, content string").coalesce(1)
    sizes = bm25.postings(texts).agg(F.count("*")).first()
    assert sizes[0] == 800


def test_ivf_candidates_of_a_batch_are_no_more_than_the_depth(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 8)))], "chunk_id int, vec array<double>").coalesce(1)
    index = ivf.build(v, f"{tmp_path}/ivf", cells=20, k=5)
    index.probes, index.depth = 20, 30  # all cells, each of fewer rows than the depth
    q = v.filter("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    found, seen = [], spark.sparkContext.accumulator(0)
    kept = ivf.kept

    def counted(batches, *args):
        for b in kept(batches, *args):
            seen.add(b.num_rows)
            yield b

    ivf.kept = counted
    try:
        found = ivf.search(q, index, 5, fill=False).collect()
    finally:
        ivf.kept = kept
    assert len(found) == 200 and seen.value <= 40 * 30 * spark.sparkContext.defaultParallelism


def test_ngrams_are_counted_before_they_leave_a_task():
    runs, n = ["\x01abcabca\x01", "\x01\U0001f600日本a\x01", "\x01x\x01", "\x01abcabca\x01"], [2, 1, 5, 3]
    want = {}
    for r, c in zip(runs, n, strict=True):
        for i in range(len(r)):
            for k in range(1, min(6, len(r) - i) + 1):
                want[r[i : i + k]] = want.get(r[i : i + k], 0) + c
    batch = pa.RecordBatch.from_pydict({"run": runs, "n": pa.array(n, pa.int64())})
    got = [g for part in segment._some(batch) for b in segment._grams(*part, 6) for g in zip(b["gram"].to_pylist(), b["n"].to_pylist(), strict=True)]
    assert len(got) == len(want) and dict(got) == want  # each n-gram is one row
    assert list(segment._some(batch.slice(0, 0))) == [] and list(segment._grams(pa.array([], pa.string()), np.zeros(0, np.int64), 6)) == []


def test_bm25_pairs_of_common_words_are_no_rows(spark, monkeypatch):
    """A word that all chunks and all queries have: tasks hand on k rows a query."""
    from orrery.operators import ranking
    from orrery.plans import sweep

    rng = np.random.default_rng(4)
    texts = [" ".join(["common", *rng.choice(["a", "b", "c", "d", "e"], 6)]) + "." for _ in range(300)]
    queries = [("common " + " ".join(rng.choice(["a", "b", "c", "d"], 1 + i % 3))).strip() for i in range(10)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    ranked, seen = ranking.top_k, []

    def counted(scores, k, route):
        seen.append((k, scores.count()))
        return ranked(scores, k, route)

    monkeypatch.setattr(ranking, "top_k", counted)
    index = bm25.build(chunks)
    got = bm25.search(asked, index, 5).collect()
    idf, avgdl = {r.term: r.idf for r in index.terms.collect()}, index.stats.first().avgdl
    for i, q in enumerate(queries):
        scores = []
        for c, t in enumerate(texts):
            words = t[:-1].split()
            gain = lambda w: words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / avgdl))  # noqa: B023, E731
            scores.append((-round(sum(idf[w] * gain(w) for w in q.split() if w in words), 6), c))
        want = [(c, -s) for s, c in sorted(scores)[:5] if s < 0]
        assert [(r.chunk_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == want
    sweep.search(chunks.selectExpr("concat(chunk_id, '.txt') as source", "content as text"), asked, [(8, 2), (16, 2)])
    assert len(seen) == 5 and all(n <= k * 10 * spark.sparkContext.defaultParallelism for k, n in seen)


def test_graph_pairs_are_no_rows(spark, monkeypatch):
    """Queries of more than one number's marks, ties, and one that reaches nothing of weight."""
    from orrery.operators import entity_graph, ranking

    rng = np.random.default_rng(5)
    hops = [(q, f"e{e}", int(rng.integers(0, 3))) for q in range(70) for e in range(9) if rng.random() < 0.7] + [(99, "none", 0)]
    held = [(c, f"e{e}", float(np.round(rng.integers(0, 4) / 4, 6))) for c in range(200) for e in range(9) if rng.random() < 0.4] + [(500, "none", 0.0)]
    h, ec = spark.createDataFrame(hops, "query_id int, entity string, hop int"), spark.createDataFrame(held, "chunk_id int, entity string, weight double")
    sums = {}
    for q, e, hop in hops:
        for c, f, w in held:
            if e == f:
                sums.setdefault(q, {}).setdefault(c, 0.0)
                sums[q][c] += w / (1 + hop)
    want = {(q, c): round(s / max(by.values()), 6) for q, by in sums.items() if max(by.values()) > 0 for c, s in by.items()}
    assert {(r.query_id, r.chunk_id): r.score for r in entity_graph.score_graph_chunks(h, ec).collect()} == want and 99 not in {q for q, _ in want}
    ranked, seen = ranking.top_k, []

    def counted(scores, k, route):
        seen.append(scores.count())
        return ranked(scores, k, route)

    monkeypatch.setattr(ranking, "top_k", counted)
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in entity_graph.best_graph_chunks(h, ec, 4).collect())
    best = {q: sorted((-s, c) for (p, c), s in want.items() if p == q)[:4] for q in sums}
    assert got == [(q, i + 1, c) for q in sorted(best) for i, (_, c) in enumerate(best[q])]
    assert seen[0] <= 4 * 70 * 2 * spark.sparkContext.defaultParallelism < len(want)


def test_paths_write_no_row_for_each_query_and_source_of_a_node(spark, monkeypatch):
    nodes = [f"n{i:03}" for i in range(700)]
    links = {(a, b) for i, a in enumerate(nodes) for b in (nodes[(i + 1) % 700], nodes[i * 2 % 700])} | {(nodes[0], b) for b in nodes[1:700:2]}
    graph = spark.createDataFrame([(a, b, ["r"]) for a, b in links], "subject string, object string, relations array<string>")
    asked = [(q, n) for q in range(550) for n in (nodes[0], nodes[q + 150])]  # two blocks of targets
    sizes, old = [], storage.written

    def counted(df, name):
        out = old(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(kg.storage, "written", counted)
    got = {(r.query_id, r.source, r.target): tuple(r.inner) for r in kg.paths(spark.createDataFrame(asked, "query_id long, node string"), graph, 3).collect()}
    step, best = {}, {}
    for a, b in links:
        step.setdefault(a, set()).add(b)
    for a in nodes:
        best[a], front = {a: ()}, [a]
        for _ in range(3):
            found = {}
            for x in front:
                for y in step[x] - best[a].keys():
                    found[y] = min(found.get(y, ("~",)), best[a][x] + (x,) * (x != a))
            best[a] |= found
            front = list(found)
    want = {(q, a, b) for q in range(550) for a, b in ((nodes[0], nodes[q + 150]), (nodes[q + 150], nodes[0])) if b in best[a]}
    assert got == {(q, a, b): best[a][b] for q, a, b in want}
    assert max(sizes) <= 2 * len(links)


def test_hops_by_marks_are_those_of_pairs(spark, monkeypatch):
    """More queries than one number has bits; no rows of pairs of entities or of (query, entity)."""
    from orrery.operators import entity_graph

    rng = np.random.default_rng(6)
    held = [(c, f"e{e}", 0.5) for c in range(60) for e in rng.choice(200, 3, replace=False)] + [(60, f"hub{i}", 1.0) for i in range(40)]
    seeds = [(q, f"e{e}") for q in range(130) for e in rng.choice(200, 2)] + [(q, "hub0") for q in range(130)] + [(7, "none")]
    ec, s = spark.createDataFrame(held, "chunk_id int, entity string, weight double"), spark.createDataFrame(seeds, "query_id int, entity string")
    edges = entity_graph.cooccurrence(ec).collect()
    pairs = spark.createDataFrame(edges, "a string, b string, weight long")
    sizes, old = [], storage.written

    def counted(df, name):
        out = old(df, name)
        sizes.append(out.count())
        return out

    for hops in (1, 3):
        want = {(r.query_id, r.entity): r.hop for r in entity_graph.khop(s, pairs, hops).collect()}
        with monkeypatch.context() as m:
            m.setattr(entity_graph.storage, "written", counted)
            got = entity_graph.reached(s, ec, hops)
            place = {(r.block, r.place): r.query_id for r in got.queries.collect()}
            rows = got.marks.collect()
        found = [(place[r.block, i], r.entity, r.hop) for r in rows for i in range(64) if r.mark >> i & 1]
        assert {(q, e): h for q, e, h in found} == want and len(found) == len(want)
    assert max(sizes) < min(len(edges), len(want))


def test_the_graph_route_makes_no_edges(spark, monkeypatch, tmp_path):
    """Neither an index nor a search over it writes pairs of entities; rows with their own id are not grouped."""
    from orrery.operators import entity_graph
    from orrery.plans import search, segments

    texts = [(i, "s", f"Alpha{i % 5} Beta{i % 7} meets Gamma{i % 3} here") for i in range(40)]
    chunks = spark.createDataFrame(texts, "chunk_id long, source string, content string")
    asked = spark.createDataFrame([(1, "Alpha1 Beta2"), (2, "Gamma0 Alpha4 Beta6")], "query_id long, query string")
    names, old = [], storage.written

    def noted(df, name):
        names.append(name)
        return old(df, name)

    def none(*args, **kwargs):
        raise AssertionError("hops are taken over pairs of entities")

    monkeypatch.setattr(storage, "written", noted)
    monkeypatch.setattr(entity_graph, "khop", none)
    shown = lambda r: sorted((x.query_id, x["rank"], x.chunk_id, x.score) for x in r.collect())
    index = search.build_index(chunks, graph=True)
    want = shown(search.routes(asked, index)["graph"])
    store = segments.Store(spark, str(tmp_path))
    store.add(chunks.filter("chunk_id < 25"))
    store.add(chunks.filter("chunk_id >= 25"))
    grown = store.index(graph=True)
    assert shown(search.routes(asked, grown)["graph"]) == want and {q for q, *_ in want} == {1, 2}
    assert "edges" not in names and not list(tmp_path.glob("views/*/edges")) and names.count("segment-chunks") == 2
    assert sorted(tuple(r) for r in grown.edges.collect()) == sorted(tuple(r) for r in entity_graph.cooccurrence(index.entities).collect())


def test_a_chunks_common_words_are_weighed_where_they_lie(spark, monkeypatch):
    """The commonest words stay with their chunks, the others are joined; the rows are the same."""
    from orrery.operators import entity_graph

    rng = np.random.default_rng(7)
    texts = [(i, " ".join([*rng.choice(["aa", "Aa", "bb", "cc", "12", "x"], 9), *(f"w{j}" for j in rng.zipf(1.5, 12) if j < 500)])) for i in range(60)]
    chunks = spark.createDataFrame(texts, "chunk_id long, content string")
    shown = lambda: sorted((r.chunk_id, r.entity, r.weight) for r in entity_graph.entity_tfidf(chunks, 4).collect())
    want, seen, small = shown(), [], entity_graph.session.small

    def sent(df, *args):
        seen.append(sorted(r.term for r in df.collect()) if "term" in df.columns else [])
        return small(df, *args)

    common = entity_graph._common
    monkeypatch.setattr(entity_graph, "_common", lambda words: common(words, 8))
    monkeypatch.setattr(entity_graph.session, "small", sent)
    assert shown() == want
    assert 1 <= len(seen[0]) <= 8 and "aa" in seen[0]
    words = spark.range(1, 1001).selectExpr("cast(id as string) as term", "id as df")
    assert common(words, 1000) == 0 and 800 <= words.filter(F.col("df") > common(words, 1000 - 1)).count() <= 999
    assert 50 <= words.filter(F.col("df") > common(words, 100)).count() <= 100


def test_windows_of_a_sweep_are_no_table(spark, monkeypatch):
    """Sentences are written, and chunks that were found; neither all chunks nor their
    words or vectors. Each pair's row is that of its own index."""
    from orrery.plans import evaluate

    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    files = [(f"s{i}.txt", " ".join(" ".join(rng.choice(words, 5)) + "." for _ in range(6))) for i in range(60)] + [("a.py", "w1 = 1\n\ndef w2():\n    return w3\n"), ("no.txt", " ")]
    files = spark.createDataFrame(files, "source string, text string")
    cases = spark.createDataFrame([(i, " ".join(rng.choice(words, 3)), "x", "") for i in range(4)], "query_id int, query string, category string, golden_answer string")
    golden = spark.createDataFrame([(i, f"s{j}.txt") for i in range(4) for j in range(i, 60, 4)], "query_id int, source string")
    held, plainly = {}, storage.written
    monkeypatch.setattr(storage, "written", lambda df, name: held.setdefault(name, plainly(df, name)))
    full = {(r.chunk_size, r.overlap): r for r in evaluate.full_sweep(files, cases, golden, sizes=(8, 16), overlaps=(2, 8)).collect()}
    columns = {c for df in held.values() for c in df.columns}
    assert "sweep-sentences" in held and not {"tf", "vec"} & columns and not {"sweep-chunks", "sweep-postings", "sweep-vectors"} & set(held)
    monkeypatch.setattr(storage, "written", plainly)
    assert len(full) == 3 and full[16, 8] == evaluate.rebuild_and_evaluate(files, cases, golden, 16, 8).first()
