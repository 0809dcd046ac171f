"""Registered runs of the evaluation drivers, the diagnostics, and of sources and
sinks, which write to the shared folder and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import registry as R
from . import storage
from .operators import entity_graph, ivf, kg, open_relations, ranking, rerank, segment, vector
from .plans import agent, evaluate, search, segments
from .sources import files, json_document, sinks
from .streaming import conversations, incremental

query, tab = R.query, R.tab


def _cases(spark, d) -> DataFrame:
    """Benchmark texts as cases; their category is their length, their text the golden answer."""
    return tab(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.expr(R.CATEGORY).alias("category"), F.col("text").alias("golden_answer"))


def _chunks(spark, d) -> DataFrame:
    """Documents as chunks, each a source of its own, as the golden pairs name them."""
    return tab(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("source"), F.col("text").alias("content"), "lang")


def _found(spark, d) -> dict[str, DataFrame]:
    seeds, ec = R._seeds(spark, d)
    graph = entity_graph.best_graph_chunks(entity_graph.reached(seeds, ec), ec, 20)
    rows = {"bm25": R.route_bm25(spark, d), "vector": R.route_words(spark, d), "graph": graph}
    return {k: storage.written(v, f"route-{k}") for k, v in rows.items()}


BASE = f"""{R.RRF}, {R.HOPS},
sg AS (SELECT query_id, chunk_id, sum(weight / (1 + hop)) AS score FROM ho JOIN ec USING (entity) GROUP BY ALL),
gs AS (SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM sg QUALIFY max(score) OVER (PARTITION BY query_id) > 0),
gr AS (SELECT * FROM (SELECT query_id, chunk_id, 'graph' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, score FROM gs) WHERE rank <= 20),
three AS (SELECT * FROM both_routes UNION ALL SELECT * FROM gr),
{R.rrf_sql("tri", "three")}, {R.ce_sql("ce", "rr")}, {R.ce_sql("tce", "tri")},
{R.MINMAX}, cb AS (SELECT query_id, chunk_id, max(score) AS score FROM mm GROUP BY ALL), cc AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM cb)"""
SEVEN = {"bm25_only": "bm", "vector_only": "ve", "graph_only": "gr", "concat_naive": "cc", "rrf_fusion": "rr", "full_pipeline": "ce", "triple_fusion": "tce"}


@query(f"{R.CE}, {R.scores_sql({'bm25': 'bm', 'vector': 've', 'rrf': 'rr', 'cross_encoder': 'ce'})} SELECT stage, {R.MEANS} FROM pq GROUP BY 1")
def q_run_evaluation(spark, d):
    found = {k: storage.written(v, "route") for k, v in (("bm25", R.route_bm25(spark, d)), ("vector", R.route_words(spark, d)))}
    return evaluate.run_evaluation(found, _cases(spark, d), R.golden(spark, d), _chunks(spark, d))[1]


def _six_sql() -> str:
    """The four routes' SQL without the entity graph's, then six stages judged."""
    hybrid = f"""hf AS (SELECT query_id, chunk_id, round(sum(CASE route WHEN 'kg' THEN {R.params.KG_RRF_WEIGHT} ELSE 1.0 END::DOUBLE / ({R.params.RRF_K} + rank)), 6) AS score, min(struct_pack(place := CASE route WHEN 'bm25' THEN 0 WHEN 'vector' THEN 1 ELSE 3 END, r := rank)) AS seen FROM (SELECT * FROM both_x UNION ALL SELECT * FROM kgr) GROUP BY ALL),
hy AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen.place, seen.r, chunk_id) AS INT) AS rank FROM hf)"""
    stages = {"bm25": "bm_x", "vector": "ve_x", "rrf": "rr_x", "graph": "kgr", "hybrid": "hy", "cross_encoder": "ce_x"}
    return f"""WITH {R._INDEX}, aq AS (SELECT item_id AS query_id, text AS query FROM benchmark), {R.routes_sql("x", "aq")},
{R.entities_sql("c", R._DOCS, R.params.GRAPH_ENTITY_TOP_N)}, {R.entities_sql("q", R._ASKED, R.params.KG_QUERY_ENTITIES)}, nq AS MATERIALIZED (SELECT DISTINCT id AS query_id, entity FROM ec_q),
{R.triples_sql()}, {R.kg_route_sql()}, {hybrid}, {R.scores_sql(stages)} SELECT stage, {R.MEANS} FROM pq GROUP BY 1"""


@query(_six_sql())
def q_run_evaluation_graph(spark, d):
    """Six stages, the knowledge graph's route among them."""
    index = search.build_index(R.chunks(spark, d))
    index.triples = storage.written(kg.clean_triples(R._doc_records(spark, d, index.words.postings)), "triples")
    cases = _cases(spark, d)
    found = {k: storage.written(v, "route") for k, v in search.routes(cases.select("query_id", "query"), index).items()}
    return evaluate.run_evaluation(found, cases, R.golden(spark, d), _chunks(spark, d))[1]


@query(f"{BASE}, {R.scores_sql(SEVEN)}, m AS (SELECT stage AS configuration, (list_position({list(SEVEN)}, stage) - 1)::INT AS ordinal, {R.MEANS} FROM pq GROUP BY 1) SELECT *, {', '.join(f'round({m} - coalesce(lag({m}) OVER (ORDER BY ordinal), {m}), 4) AS delta_{m}' for m in evaluate.METRICS)} FROM m")
def q_module_ablation(spark, d):
    return evaluate.run_module_ablation(_found(spark, d), _cases(spark, d), R.golden(spark, d), _chunks(spark, d))


FIVE = {k: v for k, v in SEVEN.items() if k not in ("concat_naive", "rrf_fusion")}
GAINS = (("bm25_to_full_gain", "bm25_only", "full_pipeline"), ("vector_to_full_gain", "vector_only", "full_pipeline"), ("full_to_triple_gain", "full_pipeline", "triple_fusion"))


@query(f"{BASE}, {R.scores_sql(FIVE)}, {R.CATS}, m AS (SELECT category, stage AS configuration, {R.MEANS} FROM pq JOIN cat USING (query_id) GROUP BY ALL) SELECT * FROM m" + "".join(f" UNION ALL SELECT a.category, '{name}', {', '.join(f'round(b.{m} - a.{m}, 4)' for m in evaluate.METRICS)} FROM m a JOIN m b USING (category) WHERE a.configuration = '{low}' AND b.configuration = '{high}'" for name, low, high in GAINS))
def q_run_category_breakdown(spark, d):
    return evaluate.run_category_breakdown(_found(spark, d), _cases(spark, d), R.golden(spark, d), _chunks(spark, d))


def _sweep_sql() -> str:
    parts, stages = [], {}
    for k in (30, 60, 120):
        parts += [R.rrf_sql(f"r{k}", "both_routes", k), R.ce_sql(f"c{k}", f"r{k}", 10)]
        for c in (3, 5, 10):
            parts.append(f"s{k}_{c} AS (SELECT * FROM c{k} WHERE rank <= {c})")
            stages[f"{k}:{c}"] = f"s{k}_{c}"
    return f"{R.BOTH}, {', '.join(parts)}, {R.scores_sql(stages)} SELECT CAST(split_part(stage, ':', 1) AS INT) AS rrf_k, CAST(split_part(stage, ':', 2) AS INT) AS ce_top_k, {R.MEANS} FROM pq GROUP BY stage"


def _quick(spark, d) -> DataFrame:
    found = {k: storage.written(v, "route") for k, v in (("bm25", R.route_bm25(spark, d)), ("vector", R.route_words(spark, d)))}
    return evaluate.quick_sweep(found, _cases(spark, d), R.golden(spark, d), _chunks(spark, d))


@query(_sweep_sql())
def q_parameter_sweep(spark, d):
    return _quick(spark, d)


@query(f"SELECT * FROM ({_sweep_sql()}) ORDER BY mrr DESC, rrf_k, ce_top_k LIMIT 1")
def q_best_config(spark, d):
    return evaluate.best_config(_quick(spark, d), "rrf_k", "ce_top_k")


#: The pairs of the full sweep.
PAIRS = [(s, o) for s in (256, 512, 1024) for o in (64, 128, 256) if o < s]


def rebuilt_sql(pairs: list[tuple[int, int]]) -> str:
    """Documents chunked under every pair, each chunking indexed, searched and judged by itself."""
    ends, tok, count = "。！？.!?", R.TOK.format("content"), R.N_TOKENS.format("x.s")
    return rf"""WITH RECURSIVE cf AS (SELECT unnest({[f"{s}:{o}" for s, o in pairs]}) AS stage),
cg AS (SELECT stage, split_part(stage, ':', 1)::BIGINT AS size, split_part(stage, ':', 2)::BIGINT AS overlap FROM cf),
d AS (SELECT doc_id || '.txt' AS source, text FROM documents WHERE trim(coalesce(text, '')) <> ''),
g AS (SELECT source, string_split(regexp_replace(text, '([{ends}])\s+', '' || chr(1), 'g'), chr(1)) AS p FROM d),
y AS (SELECT source, list_filter(list_transform(p, lambda x: struct_pack(s := regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x.s <> '') AS raw FROM g),
c AS (SELECT source, raw, list_transform(raw, lambda x: {count}) AS n FROM y WHERE len(raw) > 0),
k AS MATERIALIZED (SELECT source, raw, n, list_transform(range(len(n) + 1), lambda k: coalesce(list_sum(n[1:k]), 0)::BIGINT) AS upto FROM c),
w AS (SELECT stage, size, overlap, source, 0 AS chunk_index, 0::BIGINT AS i, greatest(len(list_filter(upto, lambda x: x <= size)) - 1, 1)::BIGINT AS j FROM k, cg
UNION ALL SELECT stage, size, overlap, source, chunk_index + 1, a, greatest(len(list_filter(upto, lambda x: x <= upto[a + 1] + size)) - 1, a + 1)::BIGINT FROM (SELECT w.*, k.upto, greatest(w.i + 1, len(list_filter(k.upto, lambda x: x <= k.upto[w.j + 1] - w.overlap)) - 1)::BIGINT AS a FROM w JOIN k USING (source) WHERE w.j < len(k.n))),
x AS MATERIALIZED (SELECT stage, source, stage || '|' || substring(md5(source || ':' || chunk_index), 1, 8) AS chunk_id, array_to_string(list_transform(list_zip(raw[i + 1:j], n[i + 1:j]), lambda z: CASE WHEN z[2] > size THEN substring(z[1].s, 1, greatest(1, (length(z[1].s) * size) // z[2])::INT) ELSE z[1].s END), '') AS content FROM w JOIN k USING (source)),
tk AS MATERIALIZED (SELECT stage, source, chunk_id, {tok} AS w FROM x),
po AS MATERIALIZED (SELECT stage, chunk_id, length, term, count(*) AS tf FROM (SELECT stage, chunk_id, len(w) AS length, unnest(w) AS term FROM tk) GROUP BY ALL),
st AS MATERIALIZED (SELECT stage, count(*) AS n, avg(len(w)) AS avgdl FROM tk WHERE len(w) > 0 GROUP BY stage),
ra AS MATERIALIZED (SELECT stage, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po JOIN st USING (stage) GROUP BY ALL),
idf AS (SELECT stage, term, CASE WHEN raw < 0 THEN {R.params.BM25_EPSILON} * avg(raw) OVER (PARTITION BY stage) ELSE raw END AS idf FROM ra),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({R.TOK.format("text")}) AS term FROM benchmark) GROUP BY ALL),
bs AS (SELECT stage, query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN po USING (stage, term) JOIN st USING (stage) GROUP BY ALL),
b2 AS (SELECT *, row_number() OVER (PARTITION BY stage, query_id ORDER BY score DESC, chunk_id) AS rank, 0 AS place FROM bs WHERE score > 0 QUALIFY rank <= 20),
hv AS (SELECT stage, chunk_id, list_transform(w, lambda x: ('0x' || substring(md5(x), 1, 8))::BIGINT % 64) AS h FROM tk),
cv AS MATERIALIZED (SELECT stage, chunk_id, list_transform(range(64), lambda k: len(list_filter(h, lambda x: x = k))::DOUBLE) AS c FROM hv),
qv AS MATERIALIZED (SELECT query_id, list_transform(range(64), lambda k: len(list_filter(h, lambda x: x = k))::DOUBLE) AS c FROM (SELECT item_id AS query_id, list_transform({R.TOK.format("text")}, lambda x: ('0x' || substring(md5(x), 1, 8))::BIGINT % 64) AS h FROM benchmark)),
vs AS (SELECT stage, query_id, chunk_id, round(list_inner_product(qv.c, cv.c) / nullif(sqrt(list_inner_product(qv.c, qv.c)) * sqrt(list_inner_product(cv.c, cv.c)), 0), 6) AS score FROM qv, cv),
v2 AS (SELECT *, row_number() OVER (PARTITION BY stage, query_id ORDER BY score DESC, chunk_id) AS rank, 1 AS place FROM vs WHERE score IS NOT NULL QUALIFY rank <= 20),
fu AS (SELECT stage, query_id, chunk_id, round(sum(1.0 / ({R.params.RRF_K} + rank)), 6) AS score, min(struct_pack(place := place, r := rank)) AS seen FROM (SELECT * FROM b2 UNION ALL SELECT * FROM v2) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY stage, query_id ORDER BY score DESC, seen.place, seen.r, chunk_id) AS fused FROM fu),
cp AS (SELECT stage, query_id, chunk_id, source, fused, coalesce(round(10.0 * len(list_intersect(list_distinct(qw), w)) / nullif(len(list_distinct(qw)), 0), 6), 0.0) AS score FROM fr JOIN tk USING (stage, chunk_id) JOIN (SELECT item_id AS query_id, {R.TOK.format("text")} AS qw FROM benchmark) USING (query_id)),
ce AS (SELECT *, row_number() OVER (PARTITION BY stage, query_id ORDER BY score DESC, fused, chunk_id) AS rank FROM cp QUALIFY rank <= {R.params.CE_TOP_K}),
{R.GOLD.strip()}, gl AS (SELECT query_id, source || '.txt' AS source FROM gold),
ju AS (SELECT ce.*, gl.source IS NOT NULL AS relevant FROM ce LEFT JOIN gl USING (query_id, source)),
pe AS (SELECT stage, query_id, min(CASE WHEN relevant AND rank <= 10 THEN rank END) AS first, count(*) FILTER (relevant AND rank <= 5) AS hits, count(*) FILTER (rank <= 5) AS returned, count(DISTINCT CASE WHEN relevant AND rank <= 5 THEN source END) AS found FROM ju GROUP BY ALL),
ng AS (SELECT query_id, count(*) AS n_golden FROM gl GROUP BY 1),
pq AS (SELECT cg.size, cg.overlap, coalesce(1.0 / first, 0.0)::DOUBLE AS mrr, (coalesce(hits, 0) > 0)::INT::DOUBLE AS hit, coalesce(hits / nullif(returned, 0), 0.0)::DOUBLE AS precision, coalesce(found / n_golden, 0.0)::DOUBLE AS recall FROM cg CROSS JOIN benchmark b LEFT JOIN pe ON pe.stage = cg.stage AND pe.query_id = b.item_id LEFT JOIN ng ON ng.query_id = b.item_id)
SELECT size::INT AS chunk_size, overlap::INT AS overlap, {R.MEANS} FROM pq GROUP BY size, overlap"""


def _texts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents as files, and golden sources by file."""
    texts = tab(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("source"), "text")
    return texts, R.golden(spark, d).select("query_id", F.concat("source", F.lit(".txt")).alias("source"))


@query(rebuilt_sql([(256, 64)]))
def q_rebuild_and_evaluate(spark, d):
    """One pair of the full sweep: documents chunked anew, golden by the chunk's document."""
    texts, golden = _texts(spark, d)
    return evaluate.rebuild_and_evaluate(texts, _cases(spark, d), golden, 256, 64)


@query(rebuilt_sql(PAIRS))
def q_full_sweep(spark, d):
    """All eight pairs in one pass."""
    texts, golden = _texts(spark, d)
    return evaluate.full_sweep(texts, _cases(spark, d), golden)


@query()
def q_latency_profile(spark, d):
    """Five timers a case: three routes, their fusion, the reranking; each case runs once, alone."""
    cases = storage.written(_cases(spark, d), "cases")
    return evaluate.latency_profile(cases, search.build_index(_chunks(spark, d), graph=True), runs=1, batches=max(1, cases.count()))


@query(f"{R.BOTH}, b5 AS (SELECT * FROM both_routes WHERE rank <= 5 AND query_id IN (1, 3, 5)), {R.rrf_sql('rr', 'b5')}, {R.ce_sql('ce', 'rr')}, st AS (SELECT route AS stage, query_id, chunk_id, rank, score FROM b5 UNION ALL SELECT 'rrf', query_id, chunk_id, rank, score FROM rr UNION ALL SELECT 'cross_encoder', query_id, chunk_id, rank, score FROM ce), {R.GOLD.strip()}, ju AS (SELECT st.*, g.source IS NOT NULL AS relevant FROM st LEFT JOIN gold g ON st.query_id = g.query_id AND st.chunk_id = g.source) SELECT query_id, stage, rank, round(score, 4) AS score, chunk_id AS source, '' AS headings, relevant, substring(text, 1, 80) AS preview, round(coalesce(1.0 / min(CASE WHEN relevant AND rank <= 10 THEN rank END) OVER (PARTITION BY query_id, stage), 0.0), 4)::DOUBLE AS mrr FROM ju JOIN documents ON doc_id = chunk_id QUALIFY rank <= 5")
def q_query_deep_dive(spark, d):
    found = {"bm25": R.route_bm25(spark, d), "vector": R.route_words(spark, d)}
    return evaluate.query_deep_dive(found, _cases(spark, d), R.golden(spark, d), _chunks(spark, d), [1, 3, 5])


def _says(prompts: list[str]) -> list[str]:
    """A model for tests: its score is a digit of the prompt's length."""
    return [f'{{"score": {len(p) % 10 / 10}, "reason": "length"}}' if "JSON" in p else f"answer of {len(p)}" for p in prompts]


def _judged_sql() -> str:
    """The test model's scores follow from the lengths of its prompts."""

    def score(kind: str) -> str:
        a, b = agent.RUBRICS[kind][:2]
        said = f"{len(agent.rubric(kind)) + len(f'## {a}') + len(f'## {b}') + 8} + length({a}) + length({b})"
        return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE ({said}) % 10 / 10 END"

    cases = f"""{R.CE}, cx AS (SELECT query_id, string_agg('[来源' || rank || ': ' || chunk_id || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM ce JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY ALL),
an AS (SELECT item_id, text AS query, text AS golden_answer, {R.CATEGORY} AS category, coalesce(context, '') AS context, CASE WHEN context IS NULL THEN '{agent.NO_HITS}' ELSE 'answer of ' || ({len(agent.GENERATE) + 4} + length(context) + length(text)) END AS answer FROM benchmark LEFT JOIN cx ON query_id = item_id),
js AS (SELECT category, {score("faithfulness")} AS faithfulness, {score("relevancy")} AS relevancy, {score("context_recall")} AS recall FROM an),
u AS (UNPIVOT js ON faithfulness, relevancy, recall INTO NAME judge VALUE v)"""
    return f"{cases} SELECT judge, coalesce(category, 'overall') AS category, round(avg(v), 4) AS mean, round(min(v), 4) AS least, round(max(v), 4) AS most FROM u GROUP BY GROUPING SETS ((judge, category), (judge))"


@query(_judged_sql())
def q_run_llm_evaluation(spark, d):
    index = search.Index(_chunks(spark, d), None, None)
    return evaluate.run_llm_evaluation(_cases(spark, d), index, _says, found=R.q_ce_rerank(spark, d))[1]


def _rewrites_sql() -> str:
    both = {"original": "ce_o", "rewritten": "ce_r"}
    shown = ", ".join(f"round({n[0]}.{m}, 4) AS {m}_{n}" for m in evaluate.METRICS for n in both)
    gains = ", ".join(f"round(r.{m} - o.{m}, 4) AS delta_{m}" for m in evaluate.METRICS[:3])
    return f"""WITH {R._INDEX}, oq AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN '检索 ' ELSE '' END || text AS query, {R.CATEGORY} AS category FROM benchmark),
rq AS (SELECT query_id, query || CASE WHEN contains(query, '优化') THEN ' 性能提升 优化方向' ELSE '' END || CASE WHEN contains(query, '检索') THEN ' 信息检索 search retrieval' ELSE '' END AS query FROM oq),
{R.routes_sql("o", "oq")}, {R.routes_sql("r", "rq")}, {R.scores_sql(both)}
SELECT oq.query_id, oq.category, oq.query AS original_query, rq.query AS rewritten_query, coalesce(round(b.score, 4), 0.0) AS ce_score_original, {shown}, {gains}, 0.0::DOUBLE AS fidelity_score, '解析失败: ' AS fidelity_reason, round(r.mrr - o.mrr, 4) > 0 AS helpful
FROM oq JOIN rq USING (query_id) LEFT JOIN ce_o b ON b.query_id = oq.query_id AND b.rank = 1 JOIN pq o ON o.query_id = oq.query_id AND o.stage = 'original' JOIN pq r ON r.query_id = oq.query_id AND r.stage = 'rewritten'"""


@query(_rewrites_sql())
def q_evaluate_rewrites(spark, d):
    cases = _cases(spark, d).withColumn("query", F.concat(F.when(F.col("query_id") % 2 == 0, "检索 ").otherwise(""), "query"))
    return evaluate.evaluate_rewrites(cases, R.golden(spark, d), search.build_index(_chunks(spark, d)))


@query(f"WITH {R.SWEEP}, b AS (SELECT threshold, f1 FROM cs WHERE f1 > 0 ORDER BY f1 DESC, threshold LIMIT 1) SELECT coalesce(max(threshold), 3.0) AS threshold, coalesce(max(f1), 0.0) AS f1, (SELECT count(*) FROM {R.CASES}) AS cases, CASE WHEN (SELECT count(*) FROM {R.CASES}) < 30 THEN 'low' ELSE 'normal' END AS confidence FROM b")
def q_calibrate_threshold(spark, d):
    return evaluate.calibrate_threshold(R._cases(spark, d).withColumnRenamed("score", "ce_score_original"))


def _diag_sql(control: bool) -> str:
    """What the knowledge graph alone finds; with control over English documents and
    the cases whose golden documents are all English."""
    usable = "ok AS (SELECT query_id FROM gold GROUP BY 1 HAVING bool_and(source IN (SELECT doc_id FROM documents WHERE lang = 'en')))"
    asked = "SELECT item_id AS id, text AS content FROM benchmark" + (" WHERE item_id IN (SELECT query_id FROM ok)" if control else "")
    triples = R.triples_sql("id").replace("JOIN documents ON doc_id = id", "JOIN documents ON doc_id = id AND lang = 'en'") if control else R.triples_sql()
    head = f"""WITH {R.GOLD.strip()}, {usable}, {R.entities_sql("c", R._DOCS, R.params.GRAPH_ENTITY_TOP_N)}, {R.entities_sql("q", asked, R.params.KG_QUERY_ENTITIES)}, nq AS MATERIALIZED (SELECT DISTINCT id AS query_id, entity FROM ec_q),
{triples}, {R.kg_route_sql(5)}"""
    if control:
        scores = R.scores_sql({"kg": "kgr"}).replace(R.GOLD + ",\n", "", 1)
        return f"{head}, {scores}, {R.CATS} SELECT coalesce(category, 'overall') AS category, count(*) AS n, round(avg(mrr), 4) AS mrr, round(avg(hit), 4) AS hit FROM pq JOIN cat USING (query_id) JOIN ok USING (query_id) GROUP BY ROLLUP (category)"
    return f"""{head}, la AS (SELECT query_id, string_agg(entity, '|' ORDER BY entity) AS query_entities FROM ka GROUP BY 1), lm AS (SELECT query_id, string_agg(node, '|' ORDER BY node) AS matched_nodes FROM km GROUP BY 1),
lt AS (SELECT query_id, string_agg(chunk_id::VARCHAR, '|' ORDER BY rank) AS top_sources, string_agg(printf('%.4f', round(score, 4)), '|' ORDER BY rank) AS top_scores FROM kgr GROUP BY 1),
lh AS (SELECT query_id, min(rank) AS hit_rank FROM kgr JOIN gold ON gold.query_id = kgr.query_id AND gold.source = kgr.chunk_id GROUP BY ALL)
SELECT b.item_id AS query_id, {R.CATEGORY} AS category, b.text AS query, query_entities, matched_nodes, top_sources, top_scores, coalesce(hit_rank, 0) AS hit_rank FROM benchmark b LEFT JOIN la ON la.query_id = item_id LEFT JOIN lm ON lm.query_id = item_id LEFT JOIN lt ON lt.query_id = item_id LEFT JOIN lh ON lh.query_id = item_id""".replace("lh AS (SELECT query_id,", "lh AS (SELECT kgr.query_id,")


@query(_diag_sql(False))
def q_kg_diag(spark, d):
    triples = storage.written(kg.clean_triples(R._doc_records(spark, d)), "triples")
    rows = evaluate.kg_diagnostics(_cases(spark, d), R.golden(spark, d), _chunks(spark, d), triples)[0]
    shown = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c in ("query_entities", "matched_nodes", "top_sources")}
    rows = rows.withColumn("hit_rank", F.coalesce("hit_rank", F.lit(0)))  # 0: none found
    return rows.withColumns(shown).withColumn("top_scores", F.array_join(F.transform("top_scores", lambda x: F.format_string("%.4f", x)), "|"))


@query(_diag_sql(True))
def q_kg_diag_control(spark, d):
    clean = tab(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("source"))
    records = R._doc_records(spark, d).withColumn("source_doc", F.col("chunk_id"))
    return evaluate.kg_control(_cases(spark, d), R.golden(spark, d), _chunks(spark, d), records, clean)[1]


@query(f"WITH {R.KG} SELECT chunk_id, source_doc, count(*) AS n FROM rec WHERE source_doc IN ('nation', 'customer') GROUP BY ALL")
def q_build_control_triples(spark, d):
    clean = spark.createDataFrame([("nation",), ("customer",)], "source string")
    return evaluate.build_control_triples(R._records(spark, d), clean).groupBy("chunk_id", "source_doc").agg(F.sum(F.size("triples")).alias("n"))


@query("SELECT conv_id AS query_id, role AS value, min(turn) AS position FROM conversations GROUP BY ALL")
def q_ordered_dedup(spark, d):
    rows = tab(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("value"), F.col("turn").alias("position"))
    return ranking.ordered_dedup(rows, "value")


@query(f"WITH {R.KG}, x AS (SELECT chunk_id, trim(s) AS s, trim(r) AS r, trim(o) AS o FROM rec WHERE s <> '' AND r <> '' AND o <> '') SELECT chunk_id, {R.ENDS.format(R.BUILT.replace('name', 's'))} AS subject, r AS relation, {R.ENDS.format(R.BUILT.replace('name', 'o'))} AS object FROM x")
def q_normalize_triple(spark, d):
    rows = R._records(spark, d).select("chunk_id", R.T.normalize_triple(kg.filter_valid_triples(F.col("triples"))).alias("t"))
    return rows.select("chunk_id", F.explode("t").alias("t")).select("chunk_id", "t.*")


# -------------------------------------------------------- triples without a model


def _relations_sql() -> str:
    o = open_relations
    return rf"""WITH se AS (SELECT doc_id AS chunk_id, source AS source_doc, unnest(x) AS t, generate_subscripts(x, 1) AS s FROM (SELECT doc_id, source, {R.SENT.format("text")} AS x FROM documents)),
wo AS MATERIALIZED (SELECT chunk_id, source_doc, s, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT chunk_id, source_doc, s, {R.TOK.format("t")} AS w FROM se)),
ns AS (SELECT count(DISTINCT (chunk_id, s)) AS n FROM wo),
ar AS MATERIALIZED (SELECT low FROM (SELECT lower(word) AS low, count(DISTINCT (chunk_id, s)) AS df FROM wo GROUP BY 1), ns WHERE length(low) >= {o.LETTERS} AND df <= greatest(1.0, {o.SHARE} * n) AND NOT regexp_matches(low, '^[0-9]+$')),
ma AS (SELECT wo.*, low IS NOT NULL AS is_arg FROM wo LEFT JOIN ar ON low = lower(word)),
tu AS (SELECT *, coalesce((is_arg <> lag(is_arg) OVER (PARTITION BY chunk_id, s ORDER BY i))::INT, 1) AS turn FROM ma),
rn AS (SELECT *, sum(turn) OVER (PARTITION BY chunk_id, s ORDER BY i) AS run FROM tu),
rs AS (SELECT chunk_id, source_doc, s, run, any_value(is_arg) AS is_arg, count(*) AS size, string_agg(word, ' ' ORDER BY i) AS said FROM rn GROUP BY ALL),
ah AS (SELECT *, lead(said) OVER w AS said_1, lead(size) OVER w AS size_1, lead(said, 2) OVER w AS said_2, lead(size, 2) OVER w AS size_2 FROM rs WINDOW w AS (PARTITION BY chunk_id, s ORDER BY run)),
fo AS MATERIALIZED (SELECT chunk_id, source_doc, said AS subject, lower(said_1) AS relation, said_2 AS object, lower(said) AS a, lower(said_2) AS b FROM ah WHERE is_arg AND size <= {o.SPAN} AND size_1 <= {o.PHRASE} AND size_2 <= {o.SPAN} AND lower(said) <> lower(said_2)),
sd AS (SELECT relation, a, b, count(*) AS evidence FROM fo GROUP BY ALL), jo AS (SELECT relation, count(*) AS support FROM sd GROUP BY 1 HAVING count(*) >= {o.SUPPORT})
SELECT chunk_id, source_doc, subject, relation, object, support, evidence, round(1 - pow(1 - support::DOUBLE / (support + {o.SUPPORT}), evidence), 4) AS confidence FROM fo JOIN sd USING (relation, a, b) JOIN jo USING (relation)"""


@query(_relations_sql())
def q_open_relations(spark, d):
    return open_relations.extracted(R.chunks(spark, d))


# ------------------------------------------------------------ unspaced text


def _unspaced(spark, d) -> DataFrame:
    """Whole texts without their blanks."""
    return tab(spark, d, "documents").select("doc_id", F.regexp_replace("text", " ", "").alias("text"))


_GRAMS = rf"""r AS (SELECT chr(1) || unnest(regexp_extract_all(replace(text, ' ', ''), '\p{{L}}+')) || chr(1) AS e FROM documents),
p AS (SELECT e, unnest(range(1, length(e) + 1)) AS i FROM (SELECT e FROM r)),
g AS MATERIALIZED (SELECT gram, count(*) AS n FROM (SELECT e[i:i + k - 1] AS gram FROM p, (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= length(e)) GROUP BY gram HAVING count(*) >= 20 OR length(gram) = 1)"""


@query(rf"""WITH {_GRAMS}, pl AS MATERIALIZED (SELECT * FROM g WHERE NOT contains(gram, chr(1))), le AS (SELECT sum(n) AS letters FROM pl WHERE length(gram) = 1),
ri AS (SELECT gram[1:-2] AS gram, sum(n * ln(n)) AS c FROM g WHERE length(gram) > 1 GROUP BY 1), lf AS (SELECT gram[2:] AS gram, sum(n * ln(n)) AS c FROM g WHERE length(gram) > 1 GROUP BY 1),
w AS (SELECT gram, n FROM pl LEFT JOIN ri USING (gram) LEFT JOIN lf USING (gram) WHERE length(gram) IN (2, 3) AND ln(n) - coalesce(ri.c, 0) / n >= {segment.ENTROPY} AND ln(n) - coalesce(lf.c, 0) / n >= {segment.ENTROPY}),
s AS (SELECT gram, n, unnest(range(1, length(gram))) AS k FROM w)
SELECT s.gram, any_value(s.n)::BIGINT AS n FROM s JOIN pl a ON a.gram = s.gram[1:k] JOIN pl b ON b.gram = s.gram[k + 1:], le GROUP BY s.gram HAVING min(ln(s.n) + ln(letters) - ln(a.n) - ln(b.n)) >= {segment.COHESION}""")
def q_segment_candidates(spark, d):
    """Words of two and three letters that whole unspaced texts give."""
    found = storage.written(segment.runs(_unspaced(spark, d), r"\p{L}+"), "runs")
    return segment.candidates(storage.written(segment.ngrams(found, 3, 20), "grams"), 3)


@query()
def q_segment(spark, d):
    """Whole texts, and the same without blanks, as what a lexicon is learnt from;
    then the words of each text without blanks."""
    bare = storage.written(_unspaced(spark, d), "unspaced")
    lexicon = segment.learn(tab(spark, d, "documents").select("text").unionByName(bare.select("text")), r"\p{L}+")
    words = R.T.tokenize(F.col("text"))
    return segment.spaced(bare, "text", lexicon).select("doc_id", F.size(words).alias("n_words"), F.md5(F.array_join(words, " ")).alias("digest"))


# -------------------------------------------------------- indexes that are stored


def _grown_sql() -> str:
    """The routes over the documents that are live in the end."""
    routes = f"""{R._INDEX}, aq AS (SELECT item_id AS query_id, text AS query FROM benchmark), {R.routes_sql("x", "aq")}, {R.graph_sql(R._DOCS, R._ASKED)}"""
    live = "kept AS MATERIALIZED (SELECT * FROM documents WHERE NOT (doc_id % 10 = 7 AND doc_id % 3 <> 2))"
    return f"WITH RECURSIVE {live}, {routes.replace('FROM documents', 'FROM kept')} SELECT * FROM both_x UNION ALL SELECT * FROM gr"


@query(_grown_sql())
def q_incremental_index(spark, d):
    """Documents added in three batches to a stored index, some deleted after the
    first and the second, some of these added again with the third; then all but two
    segments joined, and every route of the index asked."""
    store, docs = segments.Store(spark, storage.fresh(spark, "segments")), R.chunks(spark, d)
    batch, ending = (lambda k: F.col("chunk_id") % 3 == k), (lambda k: F.col("chunk_id") % 10 == k)
    store.add(docs.filter(batch(0)))
    store.delete(docs.filter(ending(3)))
    store.add(docs.filter(batch(1)))
    store.delete(docs.filter(ending(7)))
    store.add(docs.filter(batch(2) | batch(0) & ending(3)))
    store.compact(2)
    found = search.routes(R.asked(spark, d), store.index(graph=True))
    return ranking.append_routes(*found.values())


def _cells(spark, d):
    queries, vectors = R._vectors(spark, d)
    return queries, vectors, ivf.build(vectors, storage.fresh(spark, "ivf"))


@query()
def q_vector_search_ivf(spark, d):
    queries, _, index = _cells(spark, d)
    return ivf.search(queries, index)


@query("SELECT count(*) * 20 AS wanted, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def q_vector_ivf_recall(spark, d):
    """Whether nine tenths of the exact neighbours are found."""
    queries, vectors, index = _cells(spark, d)
    true = vector.search(queries, vectors).select("query_id", "chunk_id", F.lit(1).alias("wanted"))
    both = true.join(ivf.search(queries, index).select("query_id", "chunk_id", F.lit(1).alias("got")), ["query_id", "chunk_id"], "left")
    return both.agg(F.sum("wanted").alias("wanted"), (F.sum("got") >= 0.9 * F.sum("wanted")).alias("recall_reached"))


# ------------------------------------------------------------ sources and sinks


@query("SELECT doc_id::VARCHAR || '.md' AS source, 'utf-8' AS encoding, replace(text, chr(13), chr(10)) AS text FROM documents")
def q_load_document(spark, d):
    """Whole texts as bytes with Windows line ends, decoded."""
    data = F.encode(F.regexp_replace("text", "\n", "\r\n"), "UTF-8")
    return files.load_documents(tab(spark, d, "documents").select(F.concat("doc_id", F.lit(".md")).alias("source"), data.alias("content")))


@query("SELECT doc_id::VARCHAR || '.pdf' AS source, text || chr(10) || chr(10) || lang AS text FROM documents")
def q_load_pdf(spark, d):
    """Whole texts as PDF files of two pages."""
    stream = lambda n, c: F.concat(F.lit(f"{n} 0 obj<</Length 0>>stream\nBT <FEFF"), F.hex(F.encode(c, "UTF-16BE")), F.lit("> Tj ET\nendstream endobj\n"))
    head = "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 5 0 R>>endobj\n4 0 obj<</Type/Page/Parent 2 0 R/Contents[6 0 R]>>endobj\n"
    data = F.encode(F.concat(F.lit(head), stream(5, "text"), stream(6, "lang"), F.lit("%%EOF")), "UTF-8")
    found = files.load_documents(tab(spark, d, "documents").select(F.concat("doc_id", F.lit(".pdf")).alias("source"), data.alias("content")))
    return found.select("source", "text")


@query("SELECT upper(source) AS line, count(*) AS n FROM documents GROUP BY 1")
def q_scan_directory(spark, d):
    """A folder of text files, listed, decoded and cut into lines."""
    folder = storage.fresh(spark, "texts")
    tab(spark, d, "documents").select(F.upper("source")).repartition(3).write.text(folder)
    found = files.load_documents(files.scan_directory(spark, folder)).filter("source like '%.txt'")
    return found.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


@query(f"WITH {R.KG} SELECT chunk_id, source_doc, s AS subject, r AS relation, o AS object FROM rec")
def q_scan_triples_jsonl(spark, d):
    path = storage.fresh(spark, "triples-json")
    sinks.sink_append_jsonl(R._records(spark, d), path)
    return files.scan_triples(spark, path).select("chunk_id", "source_doc", F.explode("triples").alias("t")).select("chunk_id", "source_doc", "t.*")


@query(f"SELECT item_id::VARCHAR AS query_id, text AS query, {R.CATEGORY} AS category, text AS golden_answer FROM benchmark")
def q_scan_golden_json(spark, d):
    path = storage.fresh(spark, "golden")
    case = F.struct(F.col("query_id").cast("string").alias("id"), "query", "category", F.array(F.lit("a.md")).alias("golden_chunk_sources"), "golden_answer", F.lit("").alias("notes"))
    rows = _cases(spark, d).agg(F.collect_list(case).alias("test_cases")).select(F.lit("cases").alias("description"), "test_cases")  # one golden set
    sinks.sink_json(rows.coalesce(1), path)
    return files.scan_golden(spark, path).select("query_id", "query", "category", "golden_answer")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_sink_json(spark, d):
    path, docs = storage.fresh(spark, "json"), tab(spark, d, "documents")
    sinks.sink_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_sink_document(spark, d):
    """Documents as one pretty JSON document, a case for each half, the first written twice."""
    path, docs = storage.fresh(spark, "document"), tab(spark, d, "documents")
    for half in (0, 1, 0):
        json_document.sink_document(docs.filter(F.col("doc_id") % 2 == half), path, f"half {half}")
    return json_document.read_document(spark, path, docs.schema)


@query("SELECT doc_id, n_chars FROM documents")
def q_sink_append_jsonl(spark, d):
    path, docs = storage.fresh(spark, "append"), tab(spark, d, "documents").select("doc_id", "n_chars")
    for k in range(2):
        sinks.sink_append_jsonl(docs.filter(F.col("doc_id") % 2 == k), path)
    return files.load_if_exists(spark, path).select("doc_id", "n_chars")


@query(f"WITH {R.KG} SELECT chunk_id, source_doc FROM rec WHERE source_doc = 'supplier'")
def q_sink_filtered_jsonl(spark, d):
    path = storage.fresh(spark, "filtered")
    sinks.sink_filtered(R._records(spark, d), spark.createDataFrame([("supplier",)], "source string"), path)
    return files.scan_triples(spark, path).select("chunk_id", "source_doc")


@query("SELECT 'r' || (doc_id % 2) AS run, lang AS part, count(*) AS n FROM documents GROUP BY ALL")
def q_sink_merge(spark, d):
    """Two runs beside each other, one of them written twice."""
    path, docs = storage.fresh(spark, "runs"), tab(spark, d, "documents")
    for run in ("r0", "r1", "r0"):
        for lang in ("en", "fr", "de", "es"):
            own = docs.filter((F.col("lang") == lang) & (F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string")) == run))
            sinks.sink_run(own.select("doc_id"), path, run, lang)
    return spark.read.parquet(path).groupBy("run", "part").agg(F.count("*").alias("n"))


@query("SELECT r_name AS done, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def q_sink_checkpoint(spark, d):
    """A run that is cut off after two cases and taken up again."""
    path, nation = storage.fresh(spark, "cases"), tab(spark, d, "nation")
    regions = [(r.r_regionkey, r.r_name) for r in tab(spark, d, "region").orderBy("r_regionkey").collect()]
    for take in (regions[:2], regions):
        done = sinks.done_cases(spark, path)
        for key, name in take:
            if name not in done:
                sinks.sink_case(nation.filter(F.col("n_regionkey") == key).select("n_name"), path, name)
    return spark.read.parquet(path).groupBy(F.col("part").alias("done")).agg(F.count("*").alias("n"))


@query("SELECT '| ' || source || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY source")
def q_sink_report_md(spark, d):
    report = sinks.report_md("Corpus", {"Documents": search.list_documents(R.chunks(spark, d))})
    return spark.createDataFrame([(x,) for x in report.split("\n") if x.startswith("| src")], "line string")


@query("SELECT vec_id AS chunk_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def q_sink_vector_store(spark, d):
    """Stored twice, the second time in place of the first, and attached."""
    path = storage.fresh(spark, "vectors")
    v = R._vectors(spark, d)[1]
    for rows in (v.limit(3), v):
        vector.store(rows, path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vector.attach(spark, path).select("chunk_id", F.size("vec").cast("long").alias("dims"), F.round(total, 4).alias("total"))


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def q_incremental(spark, d):
    """Events that arrive in two parts, each processed once."""
    src, out, mark = (storage.fresh(spark, n) for n in ("arrivals", "processed", "progress"))
    events = tab(spark, d, "events").select("event_id", "event_type")
    for k in range(2):
        sinks.sink_append_jsonl(events.filter(F.col("event_id") % 2 == k), src)
        for _ in range(2):
            incremental.incremental(spark, src, "event_id long, event_type string", out, mark, lambda df: df)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT conv_id, count(DISTINCT turn) AS n_turns, sum(length(text))::BIGINT AS n_chars, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, false AS closed FROM conversations GROUP BY 1")
def q_state_over_turns(spark, d):
    """Turns in two shuffled parts, the first arriving again with the second; the stream
    is stopped between them and taken up from its checkpoint."""
    src, out, mark = (storage.fresh(spark, n) for n in ("turns", "states", "progress"))
    turns = tab(spark, d, "conversations").withColumn("part", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(2)))
    for parts in ([0], [0, 1]):
        turns.filter(F.col("part").isin(parts)).drop("part").write.mode("append").json(src)
        conversations.replay(spark.readStream.schema("conv_id long, turn long, role string, text string").json(src), out, mark)
    return conversations.latest(spark.read.parquet(out))


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n FROM documents")
def q_kg_build(spark, d):
    """The build run twice over whole texts with a model for tests: the second run finds nothing to do."""
    path = storage.fresh(spark, "kg")
    rows = R.chunks(spark, d).select(F.col("chunk_id").cast("string").alias("chunk_id"), "source", F.concat(F.col("chunk_id").cast("string"), F.lit("\n"), "content").alias("content"))

    def model(prompts: list[str]) -> list[str]:
        return ["none" if int(p.split("\n")[1]) % 3 == 0 else '[{"subject": "text", "relation": "has", "object": "words"}]' for p in prompts]

    for _ in range(2):
        agent.run_kg_build(rows, path, model)
    return kg.load_cache(spark, path).select(F.col("chunk_id").cast("long").alias("chunk_id"), "status", F.size("triples").alias("n"))


@query(f"{R.CE} SELECT query_id, chunk_id, rank, score FROM ce")
def q_rerank_scorer(spark, d):
    """The reranker with a scorer in Python, which gets Arrow batches of pairs."""
    import re

    words = re.compile(r"[^\W_]+")

    def scorer(queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            own = set(words.findall(q))
            out.append(round(10.0 * len(own & set(words.findall(t))) / len(own), 6) if own else 0.0)
        return out

    fused = storage.written(ranking.rrf(R._both(spark, d)), "fused")
    return rerank.rerank(fused, R.asked(spark, d), R.chunks(spark, d), scorer=scorer).select("query_id", "chunk_id", "rank", "score")
