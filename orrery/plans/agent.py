"""The bounded retrieval loop, rewriting, answers, and the model interfaces.

Models are functions of a list of prompts to a list of answers. Every one has a
deterministic stand-in for when it is missing or returns nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params, storage
from ..functions import text as T
from ..operators import kg, ranking
from ..sources import sinks
from . import search

Model = Callable[[list[str]], list[str]]

#: What the rule-based rewrite appends, and its triggers.
EXPANSIONS = (("优化", "性能提升 优化方向"), ("检索", "信息检索 search retrieval"))
NO_RESULT = "未找到相关文档，请尝试更换查询表述。"
NO_HITS = "[无检索结果]"
#: Fixed formats of answers without a model: the head, and each chunk's part.
ANSWER_HEAD = "[本地 LLM 未连接] 基于检索结果 (共 %d 次检索, Top-%d 结果):\n\n"
ANSWER_PART = "--- 来源 %d: %s | CE Score: %.4f ---\n%s\n\n"
#: Each judge's inputs, what it is asked, and its bands from best to worst.
RUBRICS = {
    "faithfulness": ("context", "answer", "Is each statement of the answer supported by the context?", ("all are, word for word or in sense", "one is a mild inference", "one or two are made up", "most are made up", "the answer contradicts the context or has nothing of it")),
    "relevancy": ("query", "answer", "Does the answer keep to the question?", ("every sentence serves it", "a little goes beyond it", "some parts are off the point", "hardly a sentence serves it", "it answers something else")),
    "context_recall": ("golden_answer", "context", "Does the context hold the points of the reference answer?", ("all of them", "all but a minor one", "the main ones, but two or more are missing", "a few of them", "none of them")),
    "fidelity": ("query", "rewritten", "Does the rewritten query ask for what the original asks for?", ("it does, fully", "it does, with a shift of stress", "it loses or adds a condition", "it only shares the topic", "it asks for something else")),
}
GENERATE = "Answer from the documents alone."
BANDS = ("1.0", "0.7 to 0.9", "0.4 to 0.6", "0.1 to 0.3", "0.0")
MISSING = {"faithfulness": "无检索上下文", "context_recall": "缺少上下文或参考答案"}


def answered(model: Model, prompts: list[str], attempts: int) -> list[str | None]:
    """The model's answers, None for a prompt that fails. A batch that fails is tried
    again with growing pauses, then halved until the prompts that fail stand alone;
    what succeeded is kept. Too many or too few answers are a failure."""
    for attempt in range(attempts):
        try:
            got = list(model(prompts))
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
            return [g or "" for g in got]
        except Exception:
            if attempt + 1 < attempts:
                time.sleep(2**attempt)
    if len(prompts) < 2:
        return [None] * len(prompts)
    half = len(prompts) // 2
    return answered(model, prompts[:half], 1) + answered(model, prompts[half:], 1)


def call_model(rows: DataFrame, prompt: str, out: str, model: Model | None, attempts: int = 3, failed: str | None = None) -> DataFrame:
    """rows with the model's answer to ``prompt`` as ``out``, an empty string where it
    failed for that prompt; with ``failed``, a column of that name tells where."""
    if model is None:
        done = rows.withColumn(out, F.lit(""))
        return done.withColumn(failed, F.lit(False)) if failed else done
    names = rows.columns

    def run(batches):
        for b in batches:
            got = answered(model, b.column(names.index(prompt)).to_pylist(), attempts) if b.num_rows else []
            columns = [*b.columns, pa.array([g or "" for g in got], pa.string())]
            if failed:
                columns.append(pa.array([g is None for g in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [*names, out, failed][: len(columns)])

    schema = rows.withColumn(out, F.lit(""))
    return rows.mapInArrow(run, (schema.withColumn(failed, F.lit(False)) if failed else schema).schema)


def rewrite_rule(query):
    parts = [F.when(query.contains(word), F.lit(more)) for word, more in EXPANSIONS]
    return F.concat_ws(" ", query, *parts)


def rewrite_query(queries: DataFrame, model: Model | None = None) -> DataFrame:
    """(query_id, query, rewritten)."""
    rows = queries.withColumn("prompt", F.concat(F.lit("改写查询，只输出改写后的文本: "), F.col("query")))
    return call_model(rows, "prompt", "said", model).select("query_id", "query", F.when(F.trim("said") != "", F.col("said")).otherwise(rewrite_rule(F.col("query"))).alias("rewritten"))


def generate_answer(found: DataFrame, queries: DataFrame, chunks: DataFrame, model: Model | None = None, k: int = 3) -> DataFrame:
    """(query_id, answer): the model's from the first k chunks; without one these
    chunks' beginnings with their scores, under a head that tells the attempts
    (the queries' ``attempt``, else 1) and the chunks found; a fixed text where
    nothing was found."""
    attempt = F.col("attempt") if "attempt" in queries.columns else F.lit(1)
    total = found.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = found.filter(F.col("rank") <= k).join(chunks.select("chunk_id", "source", "content"), "chunk_id")
    source = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    shown = F.format_string(ANSWER_PART, F.col("rank"), source, F.col("score"), F.substring("content", 1, 300))
    told = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), source, F.lit("\n"), F.col("content"))
    parts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown"), told.alias("told")))).alias("ps")).join(total, "query_id")
    base = parts.select("query_id", "total", F.array_join(F.transform("ps", lambda x: x["shown"]), "").alias("shown"), F.array_join(F.transform("ps", lambda x: x["told"]), "\n\n").alias("told"))
    asked = queries.select("query_id", "query", attempt.alias("attempt")).join(base, "query_id", "left")
    asked = asked.withColumn("prompt", F.concat_ws("\n\n", F.lit("Answer from the documents alone, in at most 300 characters, and say so if they don't tell."), "told", "query"))
    said = call_model(asked, "prompt", "said", model)
    plain = F.concat(F.format_string(ANSWER_HEAD, "attempt", "total"), "shown")
    return said.select("query_id", F.when(F.col("shown").isNull(), NO_RESULT).when(F.trim("said") != "", F.col("said")).otherwise(plain).alias("answer"))


def retrieve_and_generate(queries: DataFrame, index: search.Index, model: Model | None = None, *, scorer=None, k: int = 2, found: DataFrame | None = None) -> DataFrame:
    """(query_id, answer, context) for judging: the context is the first three
    chunks of the reranked rows, the answer the model's, else the beginnings of the
    first k; a fixed answer and no context where nothing is found."""
    if found is None:
        found = search.fusion_pipeline(search.routes(queries, index), queries, index.chunks, scorer=scorer)["cross_encoder"]
    found = storage.written(found, "judged-rows")
    context = ranking.first_k_context(found, index.chunks)
    rows = found.filter(F.col("rank") <= k).join(index.chunks.select("chunk_id", "source", "content"), "chunk_id")
    part = F.concat(F.lit("[来源: "), F.coalesce(F.col("source").cast("string"), F.lit("?")), F.lit("] "), F.substring("content", 1, 300))
    plain = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("ps"))
    plain = plain.select("query_id", F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n").alias("plain"))
    asked = queries.select("query_id", "query").join(context, "query_id", "left").join(plain, "query_id", "left")
    asked = asked.withColumn("prompt", F.concat_ws("\n\n", F.lit(GENERATE), "context", "query"))
    said = call_model(asked, "prompt", "said", model)
    answer = F.when(F.col("context").isNull(), NO_HITS).when(F.trim("said") != "", F.col("said")).otherwise(F.col("plain"))
    return said.select("query_id", answer.alias("answer"), F.coalesce("context", F.lit("")).alias("context"))


@dataclass
class Run:
    """An agent's run over all queries: its log (query_id, attempt, query, best),
    chunks (query_id, attempt, chunk_id, rank, score) of the attempts answered
    from, and answers (query_id, attempts, answer)."""

    log: DataFrame
    chunks: DataFrame
    answers: DataFrame


def run_queries(queries: DataFrame, index: search.Index, *, threshold: float = params.CE_THRESHOLD, attempts: int = params.MAX_ATTEMPTS, model: Model | None = None, scorer=None, use: str = "latest") -> Run:
    """Each attempt searches the queries whose best score was still below the
    threshold, rewritten; at most ``attempts`` passes, unrolled, each a subset of
    the one before. The answer is made from the chunks of the ``latest`` attempt,
    or of the ``first``."""
    if use not in ("first", "latest"):
        raise ValueError(f"unknown use: {use}")
    log, found, active = None, None, queries.select("query_id", "query")
    for attempt in range(1, attempts + 1):
        ranked = search.fusion_pipeline(search.routes(active, index), active, index.chunks, scorer=scorer)["cross_encoder"]
        ranked = storage.written(ranked.withColumn("attempt", F.lit(attempt)), "attempt-rows")
        best = ranked.groupBy("query_id").agg(F.max("score").alias("best"))
        now = active.join(best, "query_id", "left").select("query_id", F.lit(attempt).alias("attempt"), "query", F.coalesce("best", F.lit(0.0)).alias("best"))
        now = storage.written(now, "attempt")
        log = now if log is None else log.unionByName(now)
        found = ranked if found is None else found.unionByName(ranked)
        if attempt < attempts:
            weak = now.filter(F.col("best") < threshold).select("query_id", "query")
            # written: the model is asked once, and all routes search what it said then
            active = storage.written(rewrite_query(weak, model).select("query_id", F.col("rewritten").alias("query")), "rewritten")
    last = log.groupBy("query_id").agg(F.max("attempt").alias("attempts"))
    of = F.lit(1) if use == "first" else F.col("attempts")
    chosen = found.join(last, "query_id").filter(F.col("attempt") == of).select("query_id", "attempt", "chunk_id", "rank", "score")
    asked = log.join(last, "query_id").filter(F.col("attempt") == F.col("attempts")).select("query_id", "query", "attempt")
    answers = generate_answer(chosen, asked, index.chunks, model).join(last, "query_id").select("query_id", "attempts", "answer")
    return Run(log, chosen, answers)


def agent_loop(queries: DataFrame, index: search.Index, **how) -> DataFrame:
    """(query_id, attempt, query, best) of each attempt."""
    return run_queries(queries, index, **how).log


def rubric(kind: str) -> str:
    """What a judge is told before its inputs."""
    _, _, question, bands = RUBRICS[kind]
    return "\n".join([question, *(f"{n}: {text}" for n, text in zip(BANDS, bands, strict=True)), 'Reply with JSON alone: {"score": a number from 0 to 1, "reason": one sentence}'])


def judge(rows: DataFrame, kind: str, model: Model | None) -> DataFrame:
    """rows with ``kind`` as struct<score, reason>; a missing input scores 0."""
    a, b, *_ = RUBRICS[kind]
    asked = rows.withColumn("prompt", F.concat_ws("\n\n", F.lit(rubric(kind)), F.lit(f"## {a}"), F.col(a), F.lit(f"## {b}"), F.col(b)))
    said = call_model(asked, "prompt", "said", model)
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return said.withColumn(kind, F.when(missing, F.struct(F.lit(0.0).alias("score"), F.lit(MISSING.get(kind, "缺少输入")).alias("reason"))).otherwise(T.parse_judge_score(F.col("said")))).drop("prompt", "said")


def extract_triples(chunks: DataFrame, model: Model | None) -> DataFrame:
    """Triple records of chunks: the model's fenced or plain JSON, checked and normalised."""
    return _extracted(chunks, model).drop("failed")


def _extracted(chunks: DataFrame, model: Model | None) -> DataFrame:
    """extract_triples with ``failed``: whether the model failed for the chunk."""
    said = call_model(chunks.withColumn("prompt", F.concat(F.lit("提取 (subject, relation, object) 三元组, JSON 数组:\n"), F.col("content"))), "prompt", "said", model, failed="failed")
    body = F.when(F.col("said").contains("```"), F.regexp_extract("said", r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)).otherwise(F.col("said"))
    triples = F.coalesce(F.from_json(body, "array<struct<subject:string,relation:string,object:string>>"), F.array().cast("array<struct<subject:string,relation:string,object:string>>"))
    return said.select("chunk_id", F.col("source").alias("source_doc"), T.normalize_triple(kg.filter_valid_triples(triples)).alias("triples"), "failed")


def build_knowledge_graph(chunks: DataFrame, cache: DataFrame, model: Model | None) -> DataFrame:
    """New triple records: chunks in the cache are skipped; append the result to it."""
    return extract_triples(kg.pending_chunks(chunks, cache), model)


def run_kg_build(chunks: DataFrame, path: str, model: Model | None, *, retry_failed: bool = False) -> DataFrame:
    """The build as a job: chunks that the cache at ``path`` doesn't have are
    extracted and their records appended, with a ``status`` (ok, or failed where no
    triple came out; ``retry_failed`` takes those up again). A chunk for which the
    model failed gets no record and is pending for the next run. Returns the
    statistics. Without a model nothing is done."""
    spark = chunks.sparkSession
    if model is None:
        raise ValueError("building needs a model")
    cache = kg.load_cache(spark, path)
    done = cache.filter("status is null or status <> 'failed'") if retry_failed else cache
    new = _extracted(kg.pending_chunks(chunks, storage.written(done.select("chunk_id"), "kg-done")), model).filter("NOT failed").drop("failed")
    new = storage.written(new.withColumn("status", F.when(F.size("triples") > 0, "ok").otherwise("failed")), "kg-new")
    sinks.sink_append_jsonl(new, path)
    return kg.build_stats(chunks, kg.load_cache(spark, path))
