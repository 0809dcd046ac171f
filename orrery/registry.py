"""Queries of the engine's own operators over the test tables, and the SQL that
states their results. Documents are the chunks, benchmark items the queries,
region, nation, supplier and customer the knowledge graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params, storage
from .functions import text as T
from .operators import bm25, chunking, entity_graph, kg, metrics, ranking, rerank, vector
from .plans import agent, search
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__.removeprefix("q_")
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def tab(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark, d) -> DataFrame:
    return tab(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("content"), "lang")


def asked(spark, d) -> DataFrame:
    return tab(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def route_bm25(spark, d) -> DataFrame:
    return bm25.search(asked(spark, d), chunks(spark, d))


def route_words(spark, d) -> DataFrame:
    """A second route: how many of the query's distinct words a chunk has."""
    q = asked(spark, d).select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("query")))).alias("term"))
    c = chunks(spark, d).select("chunk_id", F.explode(F.array_distinct(T.tokenize(F.col("content")))).alias("term"))
    return bm25.added_up(q.withColumn("weight", F.lit(1.0)), asked(spark, d).count(), c.withColumn("gain", F.lit(1.0)), params.VECTOR_TOP_K, "vector")


def golden(spark, d) -> DataFrame:
    """(query_id, chunk): chunks that share a sentence of 40 characters or more."""
    long = lambda x: F.length(x) >= 40
    q = asked(spark, d).select("query_id", F.explode(F.filter(T.split_sentences(F.col("query")), long)).alias("s"))
    c = chunks(spark, d).select("chunk_id", F.explode(F.filter(T.split_sentences(F.col("content")), long)).alias("s"))
    return c.join(q, "s").select("query_id", F.col("chunk_id").alias("source")).distinct()


# ---------------------------------------------------------------- SQL parts

TOK = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"
SENT = r"list_filter(list_transform(string_split(regexp_replace({}, '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
BM25 = f"""
d AS (SELECT doc_id AS chunk_id, {TOK.format("text")} AS w FROM documents),
e AS (SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM d),
p AS MATERIALIZED (SELECT term, chunk_id, length, count(*) AS tf FROM e GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d WHERE len(w) > 0),
t AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term),
a AS MATERIALIZED (SELECT avg(raw) AS mean FROM t),
i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM t, a),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOK.format("text")}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM q JOIN i USING (term) JOIN p USING (term), s GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, chunk_id, 'bm25' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, score FROM sc WHERE score > 0) WHERE rank <= 20)"""
WORDS = f"""
wq AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format("text")}) AS term FROM benchmark),
wd AS (SELECT DISTINCT doc_id AS chunk_id, unnest({TOK.format("text")}) AS term FROM documents),
ws AS (SELECT query_id, chunk_id, CAST(count(*) AS DOUBLE) AS score FROM wq JOIN wd USING (term) GROUP BY ALL),
ve AS (SELECT * FROM (SELECT query_id, chunk_id, 'vector' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, score FROM ws) WHERE rank <= 20)"""
BOTH = f"WITH {BM25}, {WORDS}, both_routes AS (SELECT * FROM bm UNION ALL SELECT * FROM ve)"
RRF = f"""{BOTH},
fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(struct_pack(place := CASE route WHEN 'bm25' THEN 0 ELSE 1 END, r := rank, route := route)) AS seen FROM both_routes GROUP BY ALL),
rr AS (SELECT query_id, chunk_id, 'rrf' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen.place, seen.r, chunk_id) AS INT) AS rank, score, seen.route AS original_source FROM fu)"""
GOLD = f"""
gold AS (SELECT DISTINCT b.item_id AS query_id, c.doc_id AS source FROM (SELECT item_id, unnest({SENT.format("text")}) AS s FROM benchmark) b JOIN (SELECT doc_id, unnest({SENT.format("text")}) AS s FROM documents) c ON b.s = c.s WHERE length(b.s) >= 40)"""


def scores_sql(stages: dict[str, str]) -> str:
    """CTEs res, jud, per and pq: metrics of each stage's table (query_id, rank, chunk_id) by query."""
    res = " UNION ALL ".join(f"SELECT '{name}' AS stage, query_id, rank, chunk_id AS source FROM {table}" for name, table in stages.items())
    names = ", ".join(f"'{name}'" for name in stages)
    return f"""{GOLD},
res AS ({res}),
jud AS (SELECT r.*, g.source IS NOT NULL AS relevant FROM res r LEFT JOIN gold g ON r.query_id = g.query_id AND r.source = g.source),
per AS (SELECT stage, query_id, min(CASE WHEN relevant AND rank <= 10 THEN rank END) AS first, count(*) FILTER (relevant AND rank <= 5) AS hits, count(*) FILTER (rank <= 5) AS returned, count(DISTINCT CASE WHEN relevant AND rank <= 5 THEN source END) AS found FROM jud GROUP BY ALL),
pq AS (SELECT s.stage, b.item_id AS query_id, coalesce(1.0 / first, 0.0)::DOUBLE AS mrr, (coalesce(hits, 0) > 0)::INT::DOUBLE AS hit, coalesce(hits / nullif(returned, 0), 0.0)::DOUBLE AS precision, coalesce(found / n_golden, 0.0)::DOUBLE AS recall
 FROM benchmark b CROSS JOIN (SELECT unnest([{names}]) AS stage) s LEFT JOIN per p ON p.stage = s.stage AND p.query_id = b.item_id LEFT JOIN (SELECT query_id, count(*) AS n_golden FROM gold GROUP BY 1) n ON n.query_id = b.item_id)"""


SCORES = f"{RRF}, {scores_sql({'bm25': 'bm', 'vector': 've', 'rrf': 'rr'})}"
MEANS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in ("mrr", "hit", "precision", "recall"))
CATEGORY = "CASE WHEN length(text) < 150 THEN 'short' WHEN length(text) < 250 THEN 'medium' ELSE 'long' END"


# ------------------------------------------------------------------- texts


@query(f"SELECT doc_id, CAST(len(w) AS INT) AS n_terms, CAST(len(list_distinct(w)) AS INT) AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {TOK.format('text')} AS w FROM documents)")
def q_tokenize(spark, d):
    w = tab(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_terms"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS INT) AS n_tokens FROM documents")
def q_count_tokens(spark, d):
    return tab(spark, d, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query(f"SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENT.format('text')} AS s FROM documents)")
def q_split_sentences(spark, d):
    s = tab(spark, d, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


MARKDOWN = "concat('# Doc ', doc_id, chr(10), text, chr(10), '## Part ', source, chr(10), lang, chr(10), '#no heading', chr(10), '# End')"


def _markdown(spark, d):
    return tab(spark, d, "documents").select("doc_id", F.expr(MARKDOWN).alias("text"))


HEADINGS = rf"""l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split({MARKDOWN}, chr(10)) AS x FROM documents)),
o AS (SELECT doc_id, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos FROM l),
h AS (SELECT doc_id, pos, CAST(length(regexp_extract(line, '^(#+)', 1)) AS INT) AS level, trim(regexp_extract(line, '^#+\s+(.+)$', 1)) AS title FROM o WHERE regexp_matches(line, '^#{{1,6}}\s+\S'))"""


@query(f"WITH {HEADINGS} SELECT * FROM h")
def q_md_headings(spark, d):
    return _markdown(spark, d).select("doc_id", F.explode(T.md_headings(F.col("text"))).alias("h")).select("doc_id", "h.*")


@query(f"WITH {HEADINGS}, e AS (SELECT doc_id, max(pos) - 1 AS upto FROM h GROUP BY 1) SELECT e.doc_id, string_agg(title, ' > ' ORDER BY pos) AS breadcrumb FROM e JOIN h ON h.doc_id = e.doc_id AND pos <= upto AND NOT EXISTS (SELECT 1 FROM h k WHERE k.doc_id = h.doc_id AND k.pos > h.pos AND k.pos <= upto AND k.level <= h.level) GROUP BY 1")
def q_heading_breadcrumb(spark, d):
    rows = _markdown(spark, d).select("doc_id", T.md_headings(F.col("text")).alias("h"))
    return rows.select("doc_id", F.array_join(T.heading_breadcrumb(F.col("h"), F.element_at("h", -1)["pos"] - 1), " > ").alias("breadcrumb"))


@query("SELECT doc_id, substring(md5(source || ':' || doc_id), 1, 8) AS chunk_id FROM documents")
def q_chunk_id(spark, d):
    return tab(spark, d, "documents").select("doc_id", T.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"))


NAMES = "(SELECT DISTINCT name FROM (SELECT o_orderpriority AS name FROM orders UNION ALL SELECT p_type FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT concat('  v', p_size, '.1 ', lower(p_brand), ' -- ') FROM part UNION ALL SELECT concat('''', lower(p_brand), '''，') FROM part))"


def _names(spark, d):
    part, orders = tab(spark, d, "part"), tab(spark, d, "orders")
    parts = [part.select(F.col(c).alias("name")) for c in ("p_type", "p_name", "p_brand")]
    return ranking.append_routes(orders.select(F.col("o_orderpriority").alias("name")), *parts, part.select(F.concat(F.lit("  v"), "p_size", F.lit(".1 "), F.lower("p_brand"), F.lit(" -- ")).alias("name")), part.select(F.concat(F.lit("'"), F.lower("p_brand"), F.lit("'，")).alias("name"))).distinct()


FIRST = "CASE WHEN regexp_matches({0}, '^[a-z]') THEN upper({0}[1]) || {0}[2:] ELSE {0} END"
BARE = r"regexp_replace(name, '^\s+|\s+$', '', 'g')"
SQUEEZED = rf"regexp_replace({BARE}, '\s+', ' ', 'g')"
ENDS = r"regexp_replace(regexp_replace({}, '-+', '-', 'g'), '^[ _-]+|[ _-]+$', '', 'g')"


@query(f"SELECT name, {FIRST.format('t')} AS entity FROM (SELECT name, regexp_replace(regexp_replace({BARE}, '[，。！？、；：'']+$', ''), '^[，。！？、；：'']+', '') AS t FROM {NAMES})")
def q_normalize_entity_graph(spark, d):
    return _names(spark, d).select("name", T.normalize_entity_graph(F.col("name")).alias("entity"))


MARKED = "[，。！？、；：''（）()【】]+"
UNVERSIONED = rf"regexp_replace(regexp_replace(regexp_replace({SQUEEZED}, '^{MARKED}', ''), '{MARKED}$', ''), '\b(v?\d+(?:\.\d+)*)\b', '', 'gi')"


@query(f"SELECT name, {FIRST.format('t')} AS entity FROM (SELECT name, {ENDS.format(UNVERSIONED)} AS t FROM {NAMES})")
def q_normalize_entity_kg_query(spark, d):
    return _names(spark, d).select("name", T.normalize_entity_kg_query(F.col("name")).alias("entity"))


BUILT = rf"regexp_replace({SQUEEZED}, '\b(v?\d+(?:\.\d+)*(?:[-_]?\w+)?)\b', '', 'gi')"


@query(f"SELECT name, {ENDS.format(BUILT)} AS entity FROM {NAMES}")
def q_normalize_entity_kg_build(spark, d):
    return _names(spark, d).select("name", T.normalize_entity_kg_build(F.col("name")).alias("entity"))


@query(rf"SELECT name, length(name) >= 2 AND NOT regexp_matches(name, '^[\d.+\-\s]+$') AND NOT regexp_matches(name, '^#+$') AS valid FROM {NAMES}")
def q_is_valid_entity(spark, d):
    return _names(spark, d).select("name", T.is_valid_entity(F.col("name")).alias("valid"))


@query("SELECT doc_id, substring(text, 1, 500) AS preview FROM documents")
def q_truncate_text(spark, d):
    return tab(spark, d, "documents").select("doc_id", T.truncate_text(F.col("text")).alias("preview"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN 0.0 WHEN 5 THEN 0.0 ELSE least(1.0, (doc_id % 30) / 10.0) END::DOUBLE AS score, CASE doc_id % 6 WHEN 5 THEN '解析失败: ' || substring('said: ' || text, 1, 100) ELSE text END AS reason FROM documents""")
def q_parse_judge_score(spark, d):
    """Answers of five shapes that quote the whole text: fenced, bare fence, plain, without a score, and no JSON."""
    kind, score = F.col("doc_id") % 6, (F.col("doc_id") % 30 / 10).alias("score")
    body = F.to_json(F.struct(score, F.col("text").alias("reason")))
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(kind == 4, F.to_json(F.struct(F.col("text").alias("reason")))).when(kind == 5, F.concat(F.lit("said: "), "text")).otherwise(body)
    return tab(spark, d, "documents").select("doc_id", T.parse_judge_score(raw).alias("s")).select("doc_id", "s.score", "s.reason")


@query("SELECT doc_id, query || CASE WHEN contains(query, '优化') THEN ' 性能提升 优化方向' ELSE '' END || CASE WHEN contains(query, '检索') THEN ' 信息检索 search retrieval' ELSE '' END AS rewritten FROM (SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN '优化 ' WHEN 1 THEN '检索优化 ' ELSE '' END, text) AS query FROM documents)")
def q_rewrite_query(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "优化 ").when(F.col("doc_id") % 3 == 1, "检索优化 ").otherwise("")
    rows = tab(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.concat(head, "text").alias("query"))
    return agent.rewrite_query(rows).select(F.col("query_id").alias("doc_id"), "rewritten")


N_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"


def windows_sql(texts: str, kind: str, headings: str = "") -> str:
    """Sentences with their places, greedy windows by recursion, and for each window
    the titles above its first sentence; ``texts`` selects (source, text)."""
    size, overlap, ends = params.CHUNK_SIZE, params.CHUNK_OVERLAP, "。！？.!?"
    crumb = "(SELECT string_agg(title, ' > ' ORDER BY pos) FROM h WHERE h.source = x.source AND h.pos <= x.at AND NOT EXISTS (SELECT 1 FROM h k WHERE k.source = h.source AND k.pos > h.pos AND k.pos <= x.at AND k.level <= h.level))" if headings else "NULL::VARCHAR"
    return rf"""WITH RECURSIVE d AS ({texts}){headings},
g AS (SELECT source, string_split(regexp_replace(text, '([{ends}])\s+', '\1' || chr(1), 'g'), chr(1)) AS p, list_transform(regexp_extract_all(text, '[{ends}](\s+)', 1), lambda x: length(x)) AS gap FROM d),
y AS (SELECT source, list_filter(list_transform(p, lambda x, i: struct_pack(s := regexp_replace(x, '^\s+|\s+$', '', 'g'), at := coalesce(list_sum(list_transform(p[1:i - 1], lambda z: length(z))), 0) + coalesce(list_sum(gap[1:i - 1]), 0) + length(regexp_extract(x, '^\s+')))), lambda x: x.s <> '') AS raw FROM g),
c AS (SELECT source, raw, list_transform(raw, lambda x: {N_TOKENS.format("x.s")}) AS n FROM y WHERE len(raw) > 0),
u AS (SELECT source, len(n) AS size, raw, list_transform(list_zip(raw, n), lambda x: CASE WHEN x[2] > {size} THEN substring(x[1].s, 1, greatest(1, (length(x[1].s) * {size}) // x[2])::INT) ELSE x[1].s END) AS parts, list_transform(range(len(n) + 1), lambda k: coalesce(list_sum(n[1:k]), 0)::BIGINT) AS upto FROM c),
w AS (SELECT source, 0 AS chunk_index, 0::BIGINT AS i, greatest(len(list_filter(upto, lambda x: x <= {size})) - 1, 1)::BIGINT AS j FROM u
UNION ALL SELECT source, chunk_index + 1, a, greatest(len(list_filter(upto, lambda x: x <= upto[a + 1] + {size})) - 1, a + 1)::BIGINT FROM (SELECT w.source, w.chunk_index, u.upto, greatest(w.i + 1, len(list_filter(u.upto, lambda x: x <= u.upto[w.j + 1] - {overlap})) - 1)::BIGINT AS a FROM w JOIN u USING (source) WHERE w.j < u.size)),
x AS (SELECT source, chunk_index, array_to_string(parts[i + 1:j], '') AS content, raw[i + 1].at AS at FROM w JOIN u USING (source))
SELECT substring(md5(source || ':' || chunk_index), 1, 8) AS chunk_id, content, source, chunk_index, CAST({N_TOKENS.format("content")} AS INT) AS token_count, '{kind}' AS source_type, 1 AS start_line, 1 AS end_line, {crumb} AS heading_breadcrumb FROM x"""


WINDOWS = windows_sql("SELECT doc_id::VARCHAR AS source, text FROM documents", "text")


@query(WINDOWS)
def q_sliding_window_chunk(spark, d):
    rows = chunking.sliding_window(tab(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))
    return chunking.finish(rows, "text").drop("headings")


LINES = rf""", ln AS (SELECT source, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT source, string_split(text, chr(10)) AS x FROM d)),
lo AS (SELECT source, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos FROM ln),
h AS (SELECT source, pos, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#+\s+(.+)$', 1)) AS title FROM lo WHERE regexp_matches(line, '^#{{1,6}}\s+\S'))"""


@query(windows_sql(f"SELECT doc_id || '.md' AS source, {MARKDOWN} AS text FROM documents", "markdown", LINES))
def q_process_document(spark, d):
    named = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return chunking.process_documents(_markdown(spark, d).select(named.alias("source"), "text")).drop("headings")


@query()
def q_chunk_by_ast(spark, d):
    """Modules that hold the whole text, as one constant and, by sentences, as the statements of a function."""
    docs = tab(spark, d, "documents")
    quoted = lambda c: F.expr(f"substring(to_json(struct({c} as t)), 6, length(to_json(struct({c} as t))) - 6)")
    said = F.array_join(F.transform(T.split_sentences(F.col("text")), lambda s: F.concat(F.lit("    say("), F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", ""), F.lit(")"))), "\n")
    head = F.concat(F.lit("import os\nTEXT = "), quoted("text"), F.lit("\ndef f"), F.col("doc_id").cast("string"), F.lit("(say):\n    pass\n"))
    code = F.concat(head, said, F.lit("\nclass C:\n    a = 1\n    def m(self):\n        pass\n    def n(self):\n        pass"))
    return chunking.ast_chunks(docs.select(F.col("doc_id").cast("string").alias("source"), code.alias("text")))


# ---------------------------------------------------------------- retrieval


@query(rf"""WITH p AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({TOK.format("text")}) AS term FROM documents),
s AS MATERIALIZED (SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]')),
t AS MATERIALIZED (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM t, s),
a AS MATERIALIZED (SELECT avg(raw) AS mean FROM r)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM r, a""")
def q_doc_freq_idf(spark, d):
    return bm25.build(chunks(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl FROM s")
def q_avgdl(spark, d):
    return bm25.corpus_stats(bm25.postings(chunks(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM25} SELECT * FROM bm")
def q_bm25_search(spark, d):
    return route_bm25(spark, d)


@query(f"WITH {WORDS} SELECT * FROM ve")
def q_topk_per_query(spark, d):
    return route_words(spark, d)


VECTORS = """pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
vs AS (SELECT * FROM (SELECT query_id, chunk_id, 'vector' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, score FROM pairs) WHERE rank <= 20)"""


def _vectors(spark, d):
    v = tab(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return v.filter(F.col("chunk_id") % 100 == 0).withColumnRenamed("chunk_id", "query_id"), v


@query(f"WITH {VECTORS} SELECT * FROM vs")
def q_vector_search(spark, d):
    return vector.search(*_vectors(spark, d))


@query()
def q_vector_search_lsh(spark, d):
    return vector.search_lsh(*_vectors(spark, d))


@query(rf"""WITH h AS (SELECT doc_id AS chunk_id, list_transform({TOK.format("text")}, lambda x: ('0x' || substring(md5(x), 1, 8))::BIGINT % 64) AS h FROM documents),
c AS (SELECT chunk_id, list_transform(range(64), lambda k: len(list_filter(h, lambda x: x = k))::DOUBLE) AS c FROM h)
SELECT chunk_id, array_to_string(list_transform(c, lambda x: printf('%.6f', x / greatest(sqrt(list_inner_product(c, c)), 1e-9))), ' ') AS vec FROM c""")
def q_embed(spark, d):
    shown = F.array_join(F.transform("vec", lambda x: F.format_string("%.6f", x)), " ")
    return vector.embed(chunks(spark, d)).select("chunk_id", shown.alias("vec"))


@query(f"{BOTH} SELECT query_id, chunk_id, rank, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM bm")
def q_normalize_by_max(spark, d):
    return ranking.normalize_by_max(route_bm25(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


MINMAX = "mm AS (SELECT query_id, chunk_id, route, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE score END AS score FROM both_routes WINDOW w AS (PARTITION BY query_id, route))"


def _both(spark, d):
    return ranking.append_routes(route_bm25(spark, d), route_words(spark, d))


@query(f"{BOTH}, {MINMAX} SELECT query_id, chunk_id, route, round(score, 6) AS score FROM mm")
def q_minmax_normalize(spark, d):
    return ranking.minmax_normalize(_both(spark, d)).select("query_id", "chunk_id", "route", F.round("score", 6).alias("score"))


@query(f"{BOTH}, {MINMAX}, b AS (SELECT query_id, chunk_id, max(score) AS score FROM mm GROUP BY ALL) SELECT query_id, chunk_id, round(score, 6) AS score FROM b")
def q_dedup_concat(spark, d):
    return ranking.dedup_concat(route_bm25(spark, d), route_words(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"{BOTH} SELECT * FROM both_routes")
def q_append_routes(spark, d):
    return _both(spark, d)


@query(f"{RRF} SELECT * FROM rr")
def q_rrf_fusion(spark, d):
    return ranking.rrf(_both(spark, d))


@query(f"{BOTH} SELECT query_id, CAST(count(*) FILTER (n = 2) AS BIGINT) AS n_both, count(*) AS n_either FROM (SELECT query_id, chunk_id, count(DISTINCT route) AS n FROM both_routes GROUP BY ALL) GROUP BY ALL")
def q_route_overlap(spark, d):
    return ranking.route_overlap(route_bm25(spark, d), route_words(spark, d))


def ce_sql(name: str, fused: str, k: int = params.CE_TOP_K) -> str:
    """CTE ``name``: the k best of a fused table by the offline scorer."""
    return f"""{name}_p AS (SELECT r.query_id, r.chunk_id, r.rank, round(10.0 * len(list_intersect(list_distinct(qw), dw)) / len(list_distinct(qw)), 6) AS score FROM {fused} r JOIN (SELECT item_id, {TOK.format("text")} AS qw FROM benchmark) b ON b.item_id = query_id JOIN (SELECT doc_id, {TOK.format("text")} AS dw FROM documents) c ON c.doc_id = chunk_id),
{name} AS (SELECT * FROM (SELECT query_id, chunk_id, 'cross_encoder' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS INT) AS rank, score FROM {name}_p) WHERE rank <= {k})"""


def rrf_sql(name: str, rows: str, k: int = params.RRF_K) -> str:
    """CTE ``name``: the unweighted fusion of a table of routes."""
    return f"""{name}_f AS (SELECT query_id, chunk_id, round(sum(1.0 / ({k} + rank)), 6) AS score, min(struct_pack(place := CASE route WHEN 'bm25' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END, r := rank)) AS seen FROM {rows} GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, 'rrf' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen.place, seen.r, chunk_id) AS INT) AS rank, score FROM {name}_f)"""


#: Postings and vectors of all documents, for any table of queries.
_INDEX = BM25[: BM25.index("q AS (SELECT query_id")] + rf"""dv AS MATERIALIZED (SELECT chunk_id, list_transform(range(64), lambda k: len(list_filter(h, lambda x: x = k))::DOUBLE) AS c FROM (SELECT chunk_id, list_transform(w, lambda x: ('0x' || substring(md5(x), 1, 8))::BIGINT % 64) AS h FROM d))"""


def routes_sql(tag: str, queries: str) -> str:
    """CTEs bm_, ve_, rr_ and ce_ with the tag: what the index's two routes, their
    fusion and the reranker give for a table of queries (query_id, query)."""
    return rf"""qt_{tag} AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOK.format("query")}) AS term FROM {queries}) GROUP BY ALL),
sc_{tag} AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM qt_{tag} JOIN i USING (term) JOIN p USING (term), s GROUP BY ALL),
bm_{tag} AS (SELECT * FROM (SELECT query_id, chunk_id, 'bm25' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, score FROM sc_{tag} WHERE score > 0) WHERE rank <= 20),
qv_{tag} AS (SELECT query_id, list_transform(range(64), lambda k: len(list_filter(h, lambda x: x = k))::DOUBLE) AS c FROM (SELECT query_id, list_transform({TOK.format("query")}, lambda x: ('0x' || substring(md5(x), 1, 8))::BIGINT % 64) AS h FROM {queries})),
vp_{tag} AS (SELECT query_id, chunk_id, round(list_inner_product(q.c, dv.c) / nullif(sqrt(list_inner_product(q.c, q.c)) * sqrt(list_inner_product(dv.c, dv.c)), 0), 6) AS score FROM qv_{tag} q, dv),
ve_{tag} AS (SELECT * FROM (SELECT query_id, chunk_id, 'vector' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, score FROM vp_{tag} WHERE score IS NOT NULL) WHERE rank <= 20),
both_{tag} AS (SELECT * FROM bm_{tag} UNION ALL SELECT * FROM ve_{tag}),
{rrf_sql(f"rr_{tag}", f"both_{tag}")},
cq_{tag} AS (SELECT r.query_id, r.chunk_id, r.rank, coalesce(round(10.0 * len(list_intersect(list_distinct(qw), dw)) / nullif(len(list_distinct(qw)), 0), 6), 0.0) AS score FROM rr_{tag} r JOIN (SELECT query_id, {TOK.format("query")} AS qw FROM {queries}) b USING (query_id) JOIN (SELECT chunk_id, w AS dw FROM d) c USING (chunk_id)),
ce_{tag} AS (SELECT * FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS INT) AS rank, score FROM cq_{tag}) WHERE rank <= 5)"""


CE = f"{RRF}, {ce_sql('ce', 'rr')}"


@query(f"{CE} SELECT * FROM ce")
def q_ce_rerank(spark, d):
    return rerank.rerank(ranking.rrf(_both(spark, d)), asked(spark, d), chunks(spark, d))


@query(f"{CE} SELECT query_id, string_agg('[来源' || rank || ': ' || source || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM ce JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY ALL")
def q_first_k_context(spark, d):
    return ranking.first_k_context(q_ce_rerank(spark, d), chunks(spark, d))


@query(f"{CE} SELECT query_id, '[本地 LLM 未连接] 基于检索结果 (共 1 次检索, Top-' || any_value(total) || ' 结果):' || chr(10) || chr(10) || string_agg('--- 来源 ' || rank || ': ' || source || ' | CE Score: ' || printf('%.4f', score) || ' ---' || chr(10) || substring(text, 1, 300) || chr(10) || chr(10), '' ORDER BY rank) AS answer FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM ce) JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY query_id")
def q_generate_answer(spark, d):
    return agent.generate_answer(q_ce_rerank(spark, d), asked(spark, d), chunks(spark, d))


@query(f"{CE} SELECT query_id, string_agg('[来源: ' || source || '] ' || substring(text, 1, 300), chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 2) AS answer, string_agg('[来源' || rank || ': ' || source || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM ce JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY ALL")
def q_retrieve_and_generate(spark, d):
    index = search.Index(chunks(spark, d), None, None)
    return agent.retrieve_and_generate(asked(spark, d), index, found=q_ce_rerank(spark, d))


def _doc_records(spark, d, post: DataFrame | None = None) -> DataFrame:
    """Triple records of documents: each one's best words, chained."""
    best = entity_graph.entity_tfidf(chunks(spark, d), 4, post=post)
    e = best.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "entity"))), lambda x: x["entity"]).alias("e"))
    pairs = F.transform(F.slice("e", 1, F.greatest(F.size("e") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("subject"), F.lit("near").alias("relation"), F.get("e", i + 1).alias("object")))
    return e.join(tab(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_doc")), "chunk_id").select("chunk_id", "source_doc", pairs.alias("triples"))


def _index(spark, d) -> search.Index:
    """All four routes over the documents, whose words are counted once."""
    index = search.build_index(chunks(spark, d), graph=True)
    index.triples = storage.written(kg.clean_triples(_doc_records(spark, d, index.words.postings)), "triples")
    return index


def entities_sql(tag: str, rows: str, top: int) -> str:
    """CTE ``ec_tag`` (id, entity, weight): the best entities of rows (id, content)."""
    weight = f"row_number() OVER (PARTITION BY id ORDER BY weight DESC, entity) <= {top}"
    return rf"""xd_{tag} AS MATERIALIZED (SELECT id, content, {TOK.format("content")} AS w FROM ({rows})),
xe_{tag} AS MATERIALIZED (SELECT id, length, word, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS word FROM xd_{tag}) GROUP BY ALL),
xi_{tag} AS MATERIALIZED (SELECT word, ln((SELECT count(content) FROM xd_{tag}) / count(*)) AS idf FROM xe_{tag} GROUP BY word),
xv_{tag} AS (SELECT id, {FIRST.format("word")} AS entity, max(round(tf / length * idf, 6)) AS weight FROM xe_{tag} JOIN xi_{tag} USING (word) WHERE length(word) >= 2 AND NOT regexp_matches(word, '^[\d.+\-\s]+$') GROUP BY ALL),
xt_{tag} AS MATERIALIZED (SELECT * FROM xv_{tag} QUALIFY {weight}),
xw_{tag} AS (SELECT id, replace(unnest(regexp_extract_all(regexp_replace(content, '([\p{{L}},;]) ', '\1' || chr(1), 'g'), '\x01\p{{Lu}}\p{{L}}+|\b\p{{L}}+\p{{N}}[\p{{L}}\p{{N}}]*')), chr(1), '') AS word FROM xd_{tag}),
xp_{tag} AS (SELECT id, entity, round(n / max(n) OVER (PARTITION BY id) * {params.POS_COEFFICIENT}, 6) AS weight FROM (SELECT id, {FIRST.format("word")} AS entity, count(*) AS n FROM xw_{tag} WHERE length(word) >= 2 GROUP BY ALL)),
ec_{tag} AS MATERIALIZED (SELECT * FROM (SELECT id, entity, max(weight) AS weight FROM (SELECT * FROM xt_{tag} UNION ALL SELECT * FROM xp_{tag}) GROUP BY ALL) QUALIFY {weight})"""


# how alike two names are: the longest block in common, then those on either side of it
_PREFIX = "coalesce(list_position(list_transform(range(least(ahi - i, bhi - j)::BIGINT), lambda t: a[(i + t + 1)::INT] = b[(j + t + 1)::INT]), false) - 1, least(ahi - i, bhi - j))"
_BLOCK = f"list_aggregate(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: struct_pack(k := ({_PREFIX})::BIGINT, i := -i, j := -j)))), 'max')"


def mapped_sql(asked: str, nodes: str) -> str:
    """CTE ``mp`` (query_id, entity, node, level) of tables asked (query_id, entity) and nodes (node)."""
    ratio, least = params.FUZZY_RATIO, params.FUZZY_LENGTH
    return f"""mx AS MATERIALIZED (SELECT query_id, entity, node FROM {asked} JOIN {nodes} ON entity = node),
mo AS MATERIALIZED (SELECT DISTINCT entity FROM {asked} WHERE entity NOT IN (SELECT entity FROM mx)),
ms AS MATERIALIZED (SELECT entity, node FROM mo, {nodes} WHERE entity <> '' AND node <> '' AND (contains(lower(node), lower(entity)) OR contains(lower(entity), lower(node)))),
fc AS MATERIALIZED (SELECT entity, node, lower(entity) AS a, lower(node) AS b FROM mo, {nodes} WHERE entity NOT IN (SELECT entity FROM ms) AND length(entity) >= {least} AND length(node) >= {least} AND 2 * least(length(entity), length(node)) >= {ratio} * (length(entity) + length(node)) AND 2 * list_sum(list_transform(list_distinct(string_split(lower(entity), '')), lambda c: least(length(lower(entity)) - length(replace(lower(entity), c, '')), length(lower(node)) - length(replace(lower(node), c, ''))))) >= {ratio} * (length(entity) + length(node)) - 1e-9),
fz AS (SELECT entity, node, a, b, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo, length(b)::BIGINT AS bhi, 0::BIGINT AS got FROM fc
UNION ALL SELECT entity, node, a, b, s.alo, s.ahi, s.blo, s.bhi, s.got FROM (SELECT entity, node, a, b, unnest([struct_pack(alo := alo, ahi := -m.i, blo := blo, bhi := -m.j, got := m.k), struct_pack(alo := m.k - m.i, ahi := ahi, blo := m.k - m.j, bhi := bhi, got := 0::BIGINT)]) AS s FROM (SELECT *, {_BLOCK} AS m FROM fz WHERE alo < ahi AND blo < bhi) WHERE m.k > 0)),
fr AS MATERIALIZED (SELECT entity, node, 2.0::DOUBLE * sum(got) / (length(any_value(a)) + length(any_value(b))) AS ratio FROM fz GROUP BY ALL),
fb AS (SELECT entity, node FROM fr WHERE ratio >= {ratio} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ratio DESC, node) = 1),
mp AS MATERIALIZED (SELECT *, 'exact' AS level FROM mx UNION ALL SELECT query_id, entity, node, 'substr' FROM {asked} JOIN ms USING (entity) UNION ALL SELECT query_id, entity, node, 'fuzzy' FROM {asked} JOIN fb USING (entity))"""


def graph_sql(chunks: str, queries: str) -> str:
    """CTEs ``gr`` (the graph's ranking) and what it needs, of chunks (id, content) and queries."""
    return f"""{entities_sql("c", chunks, params.GRAPH_ENTITY_TOP_N)}, {entities_sql("q", queries, params.KG_QUERY_ENTITIES)},
nq AS MATERIALIZED (SELECT DISTINCT id AS query_id, entity FROM ec_q), nn AS MATERIALIZED (SELECT DISTINCT entity AS node FROM ec_c),
{mapped_sql("nq", "nn")},
gq AS (SELECT query_id FROM mp GROUP BY 1 HAVING count(DISTINCT entity) >= 2),
gs AS MATERIALIZED (SELECT DISTINCT query_id, node AS entity FROM mp WHERE query_id IN (SELECT query_id FROM gq)),
ge AS MATERIALIZED (SELECT DISTINCT x.entity AS a, y.entity AS b FROM ec_c x JOIN ec_c y ON x.id = y.id AND x.entity <> y.entity WHERE x.entity IN (SELECT entity FROM gs)),
gh AS MATERIALIZED (SELECT query_id, entity, min(hop) AS hop FROM (SELECT query_id, entity, 0 AS hop FROM gs UNION ALL SELECT DISTINCT query_id, b, 1 FROM gs JOIN ge ON a = entity) GROUP BY ALL),
gt AS (SELECT query_id, id AS chunk_id, sum(weight / (1 + hop)) AS score FROM gh JOIN ec_c USING (entity) GROUP BY ALL),
gz AS (SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM gt QUALIFY max(score) OVER (PARTITION BY query_id) > 0),
gr AS MATERIALIZED (SELECT * FROM (SELECT query_id, chunk_id, 'graph' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, score FROM gz) WHERE rank <= {params.GRAPH_TOP_K})"""


def triples_sql(source: str = "source") -> str:
    """CTEs ``rec`` and ``tr``: the documents' best words, chained (after graph_sql or entities_sql("c"))."""
    return rf"""wk AS (SELECT id, list(entity ORDER BY weight DESC, entity) AS e FROM (SELECT * FROM xv_c QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, entity) <= 4) GROUP BY id),
rec AS (SELECT id AS chunk_id, {source} AS source_doc, e[i] AS s, e[i + 1] AS o FROM (SELECT id, e, unnest(range(1, len(e))) AS i FROM wk) JOIN documents ON doc_id = id),
tr AS MATERIALIZED (SELECT chunk_id, source_doc, {FIRST.format("s2")} AS subject, 'near' AS relation, {FIRST.format("o2")} AS object FROM (SELECT *, {CLEAN("s")} AS s2, {CLEAN("o")} AS o2 FROM rec) WHERE length(s2) >= 2 AND length(o2) >= 2 AND NOT regexp_matches(s2, '^[\d.+\-\s]+$') AND NOT regexp_matches(o2, '^[\d.+\-\s]+$'))"""


def kg_route_sql(k: int = params.KG_TOP_K) -> str:
    """CTE ``kgr``: the knowledge graph's ranking of the queries' entities ``nq`` (after triples_sql)."""
    return f"""ka AS MATERIALIZED (SELECT DISTINCT query_id, {FIRST.format("x")} AS entity FROM (SELECT query_id, {CLEAN("entity")} AS x FROM nq)),
kx AS MATERIALIZED (SELECT DISTINCT unnest([subject, object]) AS entity, chunk_id FROM tr),
{KGQ[KGQ.index("kn AS (SELECT"):].replace("a JOIN kn ON contains", "a JOIN kn ON a.entity <> '' AND contains").replace("OR contains(lower(a.entity), lower(node)) WHERE", "OR a.entity <> '' AND contains(lower(a.entity), lower(node)) WHERE")},
{KGR[len(KGQ) + 2:]},
kgr AS MATERIALIZED (SELECT * FROM (SELECT query_id, chunk_id, 'kg' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, score FROM kz) WHERE rank <= {k})"""


_DOCS = "SELECT doc_id AS id, text AS content FROM documents"
_ASKED = "SELECT item_id AS id, text AS content FROM benchmark"


def four_routes_sql() -> str:
    """All four routes over documents: ``bm_x``, ``ve_x``, ``gr``, ``kgr`` and their weighted fusion ``fu4``."""
    weight = f"CASE route WHEN 'graph' THEN {params.GRAPH_RRF_WEIGHT} WHEN 'kg' THEN {params.KG_RRF_WEIGHT} ELSE 1.0 END::DOUBLE"
    place = "CASE route WHEN 'bm25' THEN 0 WHEN 'vector' THEN 1 WHEN 'graph' THEN 2 ELSE 3 END"
    return f"""WITH RECURSIVE {_INDEX}, aq AS (SELECT item_id AS query_id, text AS query FROM benchmark), {routes_sql("x", "aq")},
{graph_sql(_DOCS, _ASKED)}, {triples_sql()}, {kg_route_sql()},
four AS MATERIALIZED (SELECT * FROM both_x UNION ALL SELECT * FROM gr UNION ALL SELECT * FROM kgr),
f4 AS (SELECT query_id, chunk_id, round(sum({weight} / ({params.RRF_K} + rank)), 6) AS score, min(struct_pack(place := {place}, r := rank, route := route)) AS seen FROM four GROUP BY ALL),
fu4 AS MATERIALIZED (SELECT query_id, chunk_id, 'rrf' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen.place, seen.r, chunk_id) AS INT) AS rank, score, seen.route AS original_source FROM f4)"""


def _search_knowledge_sql() -> str:
    return f"""{four_routes_sql()}, {ce_sql("ce4", "fu4")}
SELECT c.query_id, c.rank, c.chunk_id, coalesce(d.source, 'unknown') AS source, substring(d.text, 1, {params.PREVIEW_CHARS}) AS content, round(c.score, 4) AS ce_score, round(f.score, 6) AS rrf_score, f.original_source FROM ce4 c JOIN fu4 f USING (query_id, chunk_id) JOIN documents d ON d.doc_id = c.chunk_id"""


# its SQL is added below, where that of the knowledge graph is known
@query()
def q_search_knowledge(spark, d):
    return search.search_knowledge(asked(spark, d), _index(spark, d))


# what these queries ask has no word that a rewrite changes: a second attempt finds the same
@query(f"""WITH {_INDEX}, aq AS (SELECT item_id AS query_id, text AS query FROM benchmark), {routes_sql('x', 'aq')},
r AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total, max(score) OVER (PARTITION BY query_id) AS best FROM ce_x)
SELECT query_id, CASE WHEN any_value(best) < 8.0 THEN 2 ELSE 1 END AS attempts, '[本地 LLM 未连接] 基于检索结果 (共 ' || CASE WHEN any_value(best) < 8.0 THEN 2 ELSE 1 END || ' 次检索, Top-' || any_value(total) || ' 结果):' || chr(10) || chr(10) || string_agg('--- 来源 ' || rank || ': ' || source || ' | CE Score: ' || printf('%.4f', score) || ' ---' || chr(10) || substring(text, 1, 300) || chr(10) || chr(10), '' ORDER BY rank) FILTER (rank <= 3) AS answer, any_value(total) AS n_chunks, any_value(best) AS best FROM r JOIN documents ON doc_id = chunk_id GROUP BY query_id""")
def q_agent_loop(spark, d):
    run = agent.run_queries(asked(spark, d), search.build_index(chunks(spark, d)), threshold=8.0)
    return run.answers.join(run.chunks.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.max("score").alias("best")), "query_id", "left")


@query("SELECT source, count(*) AS n_chunks FROM documents GROUP BY 1")
def q_list_documents(spark, d):
    return search.list_documents(chunks(spark, d))


@query("SELECT count(*) AS n_chunks FROM documents")
def q_get_chunk_count(spark, d):
    return search.get_chunk_count(chunks(spark, d))


@query("SELECT doc_id AS chunk_id, source, text AS content, lang FROM documents WHERE doc_id = 7")
def q_get_chunk(spark, d):
    return search.get_chunk(chunks(spark, d), 7)


# --------------------------------------------------------------- evaluation


def _results(spark, d):
    both = storage.written(_both(spark, d), "routes")
    all_ = both.unionByName(ranking.rrf(both).drop("original_source"))
    return all_.select(F.col("route").alias("stage"), "query_id", "rank", F.col("chunk_id").alias("source"))


def _stages(spark):
    return spark.createDataFrame([("bm25", 1), ("vector", 2), ("rrf", 3)], "stage string, ordinal int")


def _scores(spark, d):
    return metrics.per_query(_results(spark, d), golden(spark, d), _stages(spark), asked(spark, d))


def _categories(spark, d):
    return tab(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(CATEGORY).alias("category"))


@query(f"{SCORES} SELECT stage, query_id, round(mrr, 6) AS mrr, hit, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pq")
def q_retrieval_metrics(spark, d):
    return _scores(spark, d).select("stage", "query_id", F.round("mrr", 6).alias("mrr"), "hit", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{SCORES} SELECT stage, round(avg(mrr), 4) AS mrr, round(avg(hit), 4) AS hit, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall FROM pq GROUP BY 1")
def q_eval_summary(spark, d):
    return metrics.eval_summary(_scores(spark, d))


CATS = f"cat AS (SELECT item_id AS query_id, {CATEGORY} AS category FROM benchmark)"


@query(f"{SCORES}, {CATS} SELECT category, round(avg(mrr) FILTER (stage = 'bm25'), 4) AS mrr_bm25, round(avg(mrr) FILTER (stage = 'vector'), 4) AS mrr_vector, round(avg(mrr) FILTER (stage = 'rrf'), 4) AS mrr_rrf, round(avg(mrr) FILTER (stage = 'rrf') - greatest(avg(mrr) FILTER (stage = 'bm25'), avg(mrr) FILTER (stage = 'vector')), 4) AS gain FROM pq JOIN cat USING (query_id) GROUP BY 1")
def q_category_breakdown(spark, d):
    return metrics.category_breakdown(_scores(spark, d), _categories(spark, d))


@query(f"{SCORES}, {CATS} SELECT coalesce(category, 'overall') AS category, count(*) AS n, round(avg(mrr), 4) AS mrr, round(avg(hit), 4) AS hit FROM pq JOIN cat USING (query_id) GROUP BY ROLLUP (category)")
def q_diag_by_category(spark, d):
    return metrics.diag_by_category(_scores(spark, d), _categories(spark, d))


@query(f"{SCORES}, m AS (SELECT stage, CASE stage WHEN 'bm25' THEN 1 WHEN 'vector' THEN 2 ELSE 3 END AS ordinal, round(avg(mrr), 4) AS mrr FROM pq GROUP BY 1) SELECT stage, ordinal, mrr, round(mrr - coalesce(lag(mrr) OVER (ORDER BY ordinal), mrr), 4) AS delta FROM m")
def q_ablation_delta(spark, d):
    return metrics.ablation_delta(metrics.eval_summary(_scores(spark, d)), _stages(spark))


@query(f"{SCORES} SELECT stage, query_id, min(rank) AS hit_rank FROM jud WHERE relevant GROUP BY ALL")
def q_hit_rank(spark, d):
    return metrics.hit_rank(_results(spark, d), golden(spark, d))


@query(f"{SCORES} SELECT stage, query_id, rank, source FROM jud WHERE relevant")
def q_golden_semi(spark, d):
    return metrics.golden_semi(_results(spark, d), golden(spark, d)).select("stage", "query_id", "rank", "source")


@query(f"WITH {GOLD} SELECT query_id, count(*) AS n_golden FROM gold GROUP BY 1 HAVING bool_and(source IN (SELECT doc_id FROM documents WHERE lang = 'en'))")
def q_filter_golden_subset(spark, d):
    clean = chunks(spark, d).filter("lang = 'en'").select(F.col("chunk_id").alias("source"))
    return metrics.filter_golden_subset(golden(spark, d), clean)


CASES = "(SELECT d.doc_id, lang AS category, (n_chars % 70) / 10.0 AS score, quality = 1 AS helpful, ((n_chars % 7) - 3) / 10.0 AS delta FROM documents d JOIN labels USING (doc_id))"


def _cases(spark, d):
    rows = tab(spark, d, "documents").join(tab(spark, d, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("category"), (F.col("n_chars") % 70 / 10.0).alias("score"), (F.col("quality") == 1).alias("helpful"), ((F.col("n_chars") % 7 - 3) / 10.0).alias("delta"))


SWEEP = f"""sw AS (SELECT threshold, count(*) FILTER (helpful AND score < threshold) AS tp, count(*) FILTER (NOT helpful AND score < threshold) AS fp, count(*) FILTER (NOT helpful AND NOT score < threshold) AS tn, count(*) FILTER (helpful AND NOT score < threshold) AS fn FROM {CASES}, (SELECT (2 + unnest(range(11))) / 2.0::DOUBLE AS threshold) GROUP BY 1),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM sw),
cs AS (SELECT threshold::DOUBLE AS threshold, tp, fp, tn, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 4) AS f1 FROM pr)"""


def _sweep(spark, d):
    steps = spark.range(11).select(((F.col("id") + 2) / 2.0).alias("threshold"))
    return metrics.confusion_sweep(_cases(spark, d), steps)


@query(f"WITH {SWEEP} SELECT * FROM cs")
def q_confusion_sweep(spark, d):
    return _sweep(spark, d)


@query(f"WITH {SWEEP} SELECT threshold, f1 FROM cs WHERE f1 > 0 ORDER BY f1 DESC, threshold LIMIT 1")
def q_argmax_config(spark, d):
    return metrics.calibrated(_sweep(spark, d), params.CE_THRESHOLD)


@query("SELECT stage, round(m, 2) AS mean_ms, round(lo, 2) AS min_ms, round(hi, 2) AS max_ms FROM (SELECT event_type AS stage, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1 UNION ALL SELECT 'total', sum(m), NULL, NULL FROM (SELECT avg(value) AS m FROM events GROUP BY event_type))")
def q_latency_stats(spark, d):
    return metrics.latency_stats(tab(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@query(f"WITH u AS (UNPIVOT (SELECT category, score / 7 AS faithfulness, (delta + 0.3) AS relevancy, CAST(helpful AS INT)::DOUBLE AS recall FROM {CASES}) ON faithfulness, relevancy, recall INTO NAME judge VALUE v) SELECT judge, coalesce(category, 'overall') AS category, round(avg(v), 4) AS mean, round(min(v), 4) AS least, round(max(v), 4) AS most FROM u GROUP BY GROUPING SETS ((judge, category), (judge))")
def q_judge_summary(spark, d):
    rows = _cases(spark, d).select("query_id", "category", (F.col("score") / 7).alias("faithfulness"), (F.col("delta") + 0.3).alias("relevancy"), F.col("helpful").cast("double").alias("recall"))
    return metrics.judge_summary(rows)


@query(f"SELECT category, count(*) AS n, count(*) FILTER (delta > 0) AS helpful, count(*) FILTER (delta < 0) AS degraded, count(*) FILTER (delta = 0) AS unchanged, round(avg((delta > 0)::INT), 4) AS helpful_rate, round(avg(delta), 4) AS mean_delta, round(max(delta) FILTER (delta <> 0), 4)::DOUBLE AS max_delta, round(min(delta) FILTER (delta <> 0), 4)::DOUBLE AS min_delta FROM {CASES} GROUP BY 1")
def q_rewrite_summary(spark, d):
    return metrics.rewrite_summary(_cases(spark, d))


@query("SELECT size, overlap FROM (SELECT unnest([256, 512, 1024]) AS size), (SELECT unnest([64, 128, 256]) AS overlap) WHERE overlap < size")
def q_sweep_grid(spark, d):
    return metrics.sweep_grid(spark.createDataFrame([(s,) for s in (256, 512, 1024)], "size int"), spark.createDataFrame([(o,) for o in (64, 128, 256)], "overlap int"))


# ------------------------------------------------------------ entity graph

ENT = rf"""gd AS (SELECT doc_id AS chunk_id, {TOK.format("text")} AS w FROM documents), gn AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
ge AS MATERIALIZED (SELECT chunk_id, length, word, count(*) AS tf FROM (SELECT chunk_id, len(w) AS length, unnest(w) AS word FROM gd) GROUP BY ALL),
gi AS (SELECT word, ln(any_value(n) / count(*)) AS idf FROM ge, gn GROUP BY word),
gv AS (SELECT chunk_id, {FIRST.format("word")} AS entity, round(tf / length * idf, 6) AS weight FROM ge JOIN gi USING (word) WHERE length(word) >= 2 AND NOT regexp_matches(word, '^[\d.+\-\s]+$')),
gb AS (SELECT chunk_id, entity, max(weight) AS weight FROM gv GROUP BY ALL),
ec AS MATERIALIZED (SELECT chunk_id, entity, weight FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, entity) AS r FROM gb) WHERE r <= 12)"""


def _tfidf(spark, d):
    return entity_graph.entity_tfidf(chunks(spark, d))


@query(f"WITH {ENT} SELECT * FROM ec")
def q_entity_tfidf(spark, d):
    return _tfidf(spark, d)


# a blank behind a letter, comma or semicolon becomes a mark, which stands for looking behind
NAMED = rf"""t AS (SELECT doc_id AS chunk_id, regexp_replace(text, '([\p{{L}},;]) ', '\1' || chr(1), 'g') AS t FROM documents),
w AS (SELECT chunk_id, replace(unnest(regexp_extract_all(t, '\x01\p{{Lu}}\p{{L}}+|\b\p{{L}}+\p{{N}}[\p{{L}}\p{{N}}]*')), chr(1), '') AS word FROM t),
n AS (SELECT chunk_id, {FIRST.format("word")} AS entity, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY ALL)"""


@query(f"WITH {NAMED} SELECT chunk_id, entity, round(n / max(n) OVER (PARTITION BY chunk_id) * {params.POS_COEFFICIENT}, 6) AS weight FROM n")
def q_entity_pos_counts(spark, d):
    return entity_graph.entity_pos_counts(chunks(spark, d))


@query(f"WITH {ENT} SELECT entity, round(sum(weight::DECIMAL(18,6)), 4)::DOUBLE AS global_weight FROM ec GROUP BY 1")
def q_entity_weights(spark, d):
    return entity_graph.entity_nodes(_tfidf(spark, d))


EDGES = f"{ENT}, ed AS (SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM ec x JOIN ec y ON x.chunk_id = y.chunk_id AND x.entity < y.entity GROUP BY ALL)"


@query(f"WITH {EDGES} SELECT * FROM ed")
def q_entity_cooccurrence(spark, d):
    return entity_graph.cooccurrence(_tfidf(spark, d))


HOPS = f"""{EDGES}, se AS (SELECT DISTINCT b.item_id AS query_id, ec.entity FROM (SELECT DISTINCT item_id, unnest({TOK.format("text")}) AS word FROM benchmark) b JOIN ec ON {FIRST.format("b.word")} = ec.entity),
bo AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
ho AS (SELECT query_id, entity, CAST(min(hop) AS INT) AS hop FROM (SELECT query_id, entity, 0 AS hop FROM se UNION ALL SELECT query_id, bo.b, 1 FROM se JOIN bo ON se.entity = bo.a) GROUP BY ALL)"""


def _seeds(spark, d):
    ec = storage.written(_tfidf(spark, d), "entities")
    words = asked(spark, d).select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("query")))).alias("w"))
    seeds = words.select("query_id", T.normalize_entity_graph(F.col("w")).alias("entity")).join(ec.select("entity").distinct(), "entity", "left_semi").select("query_id", "entity")
    return seeds, ec


@query(f"WITH {HOPS} SELECT * FROM ho")
def q_khop_expand(spark, d):
    seeds, ec = _seeds(spark, d)
    return entity_graph.khop(seeds, entity_graph.cooccurrence(ec))


@query(f"WITH {HOPS}, sg AS (SELECT query_id, chunk_id, sum(weight / (1 + hop)) AS score FROM ho JOIN ec USING (entity) GROUP BY ALL) SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM sg QUALIFY max(score) OVER (PARTITION BY query_id) > 0")
def q_score_graph_chunks(spark, d):
    seeds, ec = _seeds(spark, d)
    return entity_graph.score_graph_chunks(entity_graph.reached(seeds, ec), ec)


@query(f"WITH RECURSIVE {ENT}, nn AS MATERIALIZED (SELECT DISTINCT entity AS node FROM ec), {entities_sql('q', _ASKED, 20)}, nq AS MATERIALIZED (SELECT DISTINCT id AS query_id, entity FROM ec_q), {mapped_sql('nq', 'nn')} SELECT * FROM mp")
def q_map_entities(spark, d):
    nodes = storage.written(_tfidf(spark, d).select("entity").distinct(), "nodes")
    named = asked(spark, d).select("query_id", F.col("query").alias("content"))
    return entity_graph.map_entities(entity_graph.entities(named, 20, "query_id").select("query_id", "entity"), nodes)


@query(f"WITH RECURSIVE {graph_sql(_DOCS, _ASKED)} SELECT * FROM gr")
def q_graph_search(spark, d):
    c, q = chunks(spark, d), asked(spark, d)
    ec = storage.written(entity_graph.entities(c), "entities")
    wanted = entity_graph.entities(q.select("query_id", F.col("query").alias("content")), 20, "query_id").select("query_id", "entity")
    return entity_graph.search(q, ec, wanted)


# --------------------------------------------------------- knowledge graph


def _records(spark, d):
    """Triples of the relational tables: places of suppliers and customers."""
    nation, region = tab(spark, d, "nation"), tab(spark, d, "region")
    s, c = tab(spark, d, "supplier"), tab(spark, d, "customer")
    t = lambda a, r, b: F.array(F.struct(F.col(a).alias("subject"), F.lit(r).alias("relation"), F.col(b).alias("object")))
    n = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    one = n.select(F.concat(F.lit("n"), "n_nationkey").alias("chunk_id"), F.lit("nation").alias("source_doc"), t("n_name", "part of", "r_name").alias("triples"))
    two = s.join(nation, s["s_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("s"), "s_suppkey").alias("chunk_id"), F.lit("supplier").alias("source_doc"), t("s_name", "based in", "n_name").alias("triples"))
    bad = c.join(nation, c["c_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("c"), "c_custkey").alias("chunk_id"), F.lit("customer").alias("source_doc"), F.when(F.col("c_custkey") % 5 == 0, t("c_name", "12.5", "n_name")).when(F.col("c_custkey") % 5 == 1, t("c_name", " ", "n_name")).otherwise(t("c_name", " lives with everyone in ", "n_name")).alias("triples"))
    return one.unionByName(two).unionByName(bad)


def _triples(spark, d):
    return kg.clean_triples(_records(spark, d))


CLEAN = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '\b(v?\d+(?:\.\d+)*)\b', '', 'gi'), '-+', '-', 'g'), '^[ _-]+|[ _-]+$', '', 'g')"
KG = f"""rec AS (SELECT 'n' || n_nationkey AS chunk_id, 'nation' AS source_doc, n_name AS s, 'part of' AS r, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, 'based in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'c' || c_custkey, 'customer', c_name, CASE c_custkey % 5 WHEN 0 THEN '12.5' WHEN 1 THEN ' ' ELSE ' lives with everyone in ' END, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
tr AS (SELECT chunk_id, source_doc, {FIRST.format("s2")} AS subject, substring(trim(r), 1, 20) AS relation, {FIRST.format("o2")} AS object FROM (SELECT *, {CLEAN("s")} AS s2, {CLEAN("o")} AS o2 FROM rec) WHERE trim(r) <> '' AND NOT regexp_matches(trim(r), '^[\\d.+\\-\\s]+$') AND length(s2) >= 2 AND length(o2) >= 2 AND NOT regexp_matches(s2, '^[\\d.+\\-\\s]+$') AND NOT regexp_matches(o2, '^[\\d.+\\-\\s]+$'))"""


@query(f"WITH {KG} SELECT * FROM tr")
def q_clean_triples(spark, d):
    return _triples(spark, d)


@query(f"WITH {KG} SELECT subject, object, array_to_string(list_sort(list(DISTINCT relation)), '|') AS relations FROM tr GROUP BY ALL")
def q_kg_edge_build(spark, d):
    return kg.edges(_triples(spark, d)).withColumn("relations", F.array_join("relations", "|"))


def _kg_chunks(spark, d):
    """The nation and supplier records' chunks; customers' are unknown but for one."""
    rows = _records(spark, d).select("chunk_id", F.col("source_doc").alias("source"))
    return rows.filter("source <> 'customer' or chunk_id = 'c2'")


KGC = "kc AS (SELECT DISTINCT chunk_id, source_doc AS source FROM rec WHERE source_doc <> 'customer' OR chunk_id = 'c2')"
KGX = f"{KG}, {KGC}, en AS (SELECT DISTINCT chunk_id, source_doc, unnest([subject, object]) AS entity FROM tr), kx AS (SELECT DISTINCT entity, chunk_id FROM (SELECT entity, chunk_id FROM en WHERE chunk_id IN (SELECT chunk_id FROM kc) UNION ALL SELECT en.entity, kc.chunk_id FROM en JOIN kc ON kc.source = en.source_doc WHERE en.chunk_id NOT IN (SELECT chunk_id FROM kc)))"


@query(f"WITH {KGX} SELECT * FROM kx")
def q_entity_chunk_index(spark, d):
    return kg.entity_chunk_index(_triples(spark, d), _kg_chunks(spark, d))


def _kg_asked(spark, d):
    """For each nation: its name, its region's name, and a fragment of it."""
    n, r = tab(spark, d, "nation"), tab(spark, d, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    s = tab(spark, d, "supplier")
    own = rows.select(F.col("n_nationkey").alias("query_id"), F.explode(F.array("r_name", F.lower(F.substring("n_name", 2, 4)))).alias("entity"))
    sup = s.select(F.col("s_nationkey").alias("query_id"), T.normalize_entity_kg_query(F.col("s_name")).alias("entity"))
    return own.unionByName(sup).distinct()


KGQ = f"""{KGX}, ka AS (SELECT DISTINCT query_id, entity FROM (SELECT n_nationkey AS query_id, unnest([r_name, lower(substring(n_name, 2, 4))]) AS entity FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_nationkey, {FIRST.format("x")} FROM (SELECT s_nationkey, {CLEAN("s_name")} AS x FROM supplier))),
kn AS (SELECT DISTINCT unnest([subject, object]) AS node FROM tr), ke AS (SELECT DISTINCT subject, object FROM tr),
m1 AS (SELECT query_id, entity, node FROM ka JOIN kn ON entity = node),
km AS (SELECT DISTINCT query_id, node FROM (SELECT query_id, node FROM m1 UNION ALL SELECT a.query_id, node FROM ka a JOIN kn ON contains(lower(node), lower(a.entity)) OR contains(lower(a.entity), lower(node)) WHERE (a.query_id, a.entity) NOT IN (SELECT (query_id, entity) FROM m1))),
p1 AS (SELECT a.query_id, a.node AS source, b.node AS target, NULL::VARCHAR AS mid FROM km a JOIN ke ON subject = a.node JOIN km b ON b.query_id = a.query_id AND b.node = object WHERE a.node <> b.node),
p2 AS (SELECT a.query_id, a.node AS source, b.node AS target, min(e.object) AS mid FROM km a JOIN ke e ON e.subject = a.node JOIN ke f ON f.subject = e.object JOIN km b ON b.query_id = a.query_id AND b.node = f.object WHERE a.node <> b.node AND e.object <> a.node AND e.object <> b.node AND (a.query_id, a.node, b.node) NOT IN (SELECT (query_id, source, target) FROM p1) GROUP BY ALL),
kp AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""


def _matched(spark, d):
    graph = storage.written(kg.edges(_triples(spark, d)), "kg-edges")
    nodes = graph.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
    return kg.match_nodes(_kg_asked(spark, d), nodes), graph


@query(f"WITH {KGQ} SELECT query_id, node FROM km")
def q_kg_match_nodes(spark, d):
    return _matched(spark, d)[0]


@query(f"WITH {KGQ} SELECT * FROM kp")
def q_kg_paths(spark, d):
    return kg.paths(*_matched(spark, d)).select("query_id", "source", "target", "mid")


KGR = f"{KGQ}, kr AS (SELECT query_id, entity, max(weight) AS weight FROM (SELECT query_id, node AS entity, 1.0::DOUBLE AS weight FROM km UNION ALL SELECT query_id, mid, 0.5::DOUBLE FROM kp WHERE mid IS NOT NULL) GROUP BY ALL), ks AS (SELECT query_id, chunk_id, sum(weight) AS score FROM kr JOIN kx USING (entity) GROUP BY ALL), kz AS (SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM ks)"


@query(f"WITH {KGR} SELECT query_id, entity, weight FROM kr")
def q_relevant_entities(spark, d):
    matched, graph = _matched(spark, d)
    return kg.relevant_entities(matched, kg.paths(matched, graph))


@query(f"WITH {KGR} SELECT * FROM (SELECT query_id, chunk_id, 'kg' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, score FROM kz) WHERE rank <= 20")
def q_kg_search(spark, d):
    return kg.search(_kg_asked(spark, d), _triples(spark, d), _kg_chunks(spark, d))


ORACLE["search_knowledge"] = _search_knowledge_sql()


_LAYERS = 5


def _paths_sql() -> str:
    """Layer by layer from every source: each node's first path, nodes reached before left out."""
    parts = ["l0 AS (SELECT DISTINCT node AS source, node, []::VARCHAR[] AS via FROM pm)"]
    for n in range(1, _LAYERS + 1):
        step = "CASE WHEN l.node = l.source THEN l.via ELSE l.via || [l.node] END"
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{k}" for k in range(n))
        parts.append(f"l{n} AS MATERIALIZED (SELECT source, node, min(via) AS via FROM (SELECT l.source, pe.object AS node, {step} AS via FROM l{n - 1} l JOIN pe ON pe.subject = l.node) WHERE (source, node) NOT IN ({seen}) GROUP BY ALL)")
    every = " UNION ALL ".join(f"SELECT source, node AS target, {n} AS hops, via FROM l{n}" for n in range(1, _LAYERS + 1))
    return f"""WITH {entities_sql("c", _DOCS, 4)}, {triples_sql()},
pe AS MATERIALIZED (SELECT DISTINCT subject, object FROM tr), pn AS (SELECT DISTINCT unnest([subject, object]) AS node FROM pe),
pm AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, node FROM (SELECT item_id, {FIRST.format("word")} AS node FROM (SELECT item_id, unnest({TOK.format("text")}) AS word FROM benchmark)) JOIN pn USING (node)),
{", ".join(parts)}, ev AS ({every})
SELECT a.query_id, ev.source, ev.target, ev.hops::INT AS hops, array_to_string(ev.via, '>') AS via FROM pm a JOIN ev ON ev.source = a.node JOIN pm b ON b.query_id = a.query_id AND b.node = ev.target WHERE ev.source <> ev.target"""


@query(_paths_sql())
def q_kg_paths_any_bound(spark, d):
    """Paths of up to five edges between the nodes that each benchmark item names, in the documents' graph."""
    graph = storage.written(kg.edges(kg.clean_triples(_doc_records(spark, d))), "kg-edges")
    nodes = graph.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    words = asked(spark, d).select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("query")))).alias("w"))
    matched = storage.written(words.select("query_id", T.normalize_entity_graph(F.col("w")).alias("node")).distinct().join(nodes, "node", "left_semi"), "kg-matched")
    found = kg.paths(matched, graph, _LAYERS)
    return found.select("query_id", "source", "target", (F.size("inner") + 1).alias("hops"), F.array_join("inner", ">").alias("via"))


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_pending_chunks(spark, d):
    return kg.pending_chunks(chunks(spark, d).select("chunk_id"), tab(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")))


@query("SELECT count(*) AS total, count(quality) AS skipped, count(*) FILTER (quality IS NULL) AS pending, coalesce(sum(quality), 0)::BIGINT AS total_triples, count(*) FILTER (quality = 0) AS failed FROM documents LEFT JOIN labels USING (doc_id)")
def q_build_stats(spark, d):
    rows = tab(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.array_repeat(F.lit("t"), F.col("quality")).alias("triples"))
    return kg.build_stats(chunks(spark, d), rows)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_windowed_counts(spark, d):
    return incremental.windowed_counts(tab(spark, d, "events")).withColumn("total", F.round("total", 4))
