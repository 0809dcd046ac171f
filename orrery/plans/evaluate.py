"""Evaluation drivers: each takes a whole set of cases as tables and returns tables.

Cases are (query_id, query, category, golden_answer), golden sources (query_id,
source). A configuration is a ranking (query_id, chunk_id, rank, score) under a
name; all configurations are judged together, in one pass over golden sources."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params, storage
from ..functions import text as T
from ..operators import entity_graph, kg, metrics, ranking, rerank
from . import agent, search

METRICS = ("mrr", "hit", "precision", "recall")


def results(rankings: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """(stage, query_id, rank, source) of all configurations."""
    rows = None
    for name, r in rankings.items():
        own = r.select(F.lit(name).alias("stage"), "query_id", "rank", "chunk_id")
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(chunks.select("chunk_id", "source"), "chunk_id").select("stage", "query_id", "rank", "source")


def scored(rankings: dict[str, DataFrame], cases: DataFrame, golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """(stage, query_id, mrr, hit, precision, recall) of every configuration and case."""
    names = chunks.sparkSession.createDataFrame([(n, i) for i, n in enumerate(rankings)], "stage string, ordinal int")
    return storage.written(metrics.per_query(results(rankings, chunks), golden, names, cases), "scores")


def fused(found: dict[str, DataFrame], names: tuple[str, ...], weights: dict[str, float] | None = None, rrf_k: int = params.RRF_K) -> DataFrame:
    return storage.written(ranking.rrf(ranking.append_routes(*[found[n] for n in names]), weights, rrf_k), "fused")


def run_evaluation(found: dict[str, DataFrame], cases: DataFrame, golden: DataFrame, chunks: DataFrame, scorer=None) -> tuple[DataFrame, DataFrame]:
    """(scores by stage and case, summary by stage): the routes bm25 and vector,
    the knowledge graph's and the weighted fusion of all three where ``found`` has
    it, the fusion of the first two, and that reranked."""
    both = fused(found, ("bm25", "vector"))
    stages = {"bm25": found["bm25"], "vector": found["vector"], "rrf": both}
    if "kg" in found:
        stages |= {"graph": found["kg"], "hybrid": fused(found, ("bm25", "vector", "kg"), {"kg": params.KG_RRF_WEIGHT})}
    stages["cross_encoder"] = rerank.rerank(both, cases, chunks, scorer=scorer)
    scores = scored(stages, cases, golden, chunks)
    return scores, metrics.eval_summary(scores)


def configurations(found: dict[str, DataFrame], cases: DataFrame, chunks: DataFrame, scorer=None) -> dict[str, DataFrame]:
    """The seven configurations of the module ablation, in order."""
    both, triple = fused(found, ("bm25", "vector")), fused(found, ("bm25", "vector", "graph"))
    return {
        "bm25_only": found["bm25"],
        "vector_only": found["vector"],
        "graph_only": found["graph"],
        "concat_naive": ranking.dedup_concat(found["bm25"], found["vector"]),
        "rrf_fusion": both,
        "full_pipeline": rerank.rerank(both, cases, chunks, scorer=scorer),
        "triple_fusion": rerank.rerank(triple, cases, chunks, scorer=scorer),
    }


def run_module_ablation(found: dict[str, DataFrame], cases: DataFrame, golden: DataFrame, chunks: DataFrame, scorer=None) -> DataFrame:
    """(configuration, ordinal, each metric, each metric's gain on the configuration before)."""
    named = configurations(found, cases, chunks, scorer)
    summary = metrics.eval_summary(scored(named, cases, golden, chunks))
    order = chunks.sparkSession.createDataFrame([(n, i) for i, n in enumerate(named)], "stage string, ordinal int")
    w = metrics.W.orderBy("ordinal")  # seven rows
    gains = [F.round(F.col(m) - F.coalesce(F.lag(m).over(w), F.col(m)), 4).alias(f"delta_{m}") for m in METRICS]
    return summary.join(order, "stage").select(F.col("stage").alias("configuration"), "ordinal", *METRICS, *gains)


def run_category_breakdown(found: dict[str, DataFrame], cases: DataFrame, golden: DataFrame, chunks: DataFrame, scorer=None) -> DataFrame:
    """(category, configuration, each metric): five configurations and, as rows of
    their own, three gains of one on another."""
    five = {k: v for k, v in configurations(found, cases, chunks, scorer).items() if k not in ("concat_naive", "rrf_fusion")}
    scores = scored(five, cases, golden, chunks).join(cases.select("query_id", "category"), "query_id")
    each = storage.written(scores.groupBy("category", F.col("stage").alias("configuration")).agg(*metrics.means(METRICS)), "by-category")
    out = each
    for name, low, high in (("bm25_to_full_gain", "bm25_only", "full_pipeline"), ("vector_to_full_gain", "vector_only", "full_pipeline"), ("full_to_triple_gain", "full_pipeline", "triple_fusion")):
        a = each.filter(F.col("configuration") == low).select("category", *[F.col(m).alias(f"low_{m}") for m in METRICS])
        b = each.filter(F.col("configuration") == high)
        out = out.unionByName(b.join(a, "category").select("category", F.lit(name).alias("configuration"), *[F.round(F.col(m) - F.col(f"low_{m}"), 4).alias(m) for m in METRICS]))
    return out


def quick_sweep(found: dict[str, DataFrame], cases: DataFrame, golden: DataFrame, chunks: DataFrame, scorer=None, rrf_ks=(30, 60, 120), ce_ks=(3, 5, 10)) -> DataFrame:
    """(rrf_k, ce_top_k, each metric): fusion and reranking depth, no index rebuilt.
    Each fusion is reranked once, to the greatest depth."""
    named = {}
    for k in rrf_ks:
        deep = storage.written(rerank.rerank(fused(found, ("bm25", "vector"), rrf_k=k), cases, chunks, max(ce_ks), scorer), "sweep")
        named |= {f"{k}:{c}": deep.filter(F.col("rank") <= c) for c in ce_ks}
    summary = metrics.eval_summary(scored(named, cases, golden, chunks))
    part = F.split("stage", ":")
    return summary.select(part[0].cast("int").alias("rrf_k"), part[1].cast("int").alias("ce_top_k"), *METRICS)


def rebuild_and_evaluate(files: DataFrame, cases: DataFrame, golden: DataFrame, size: int, overlap: int, scorer=None) -> DataFrame:
    """One row of metrics of the full pipeline over files (source, text) chunked anew."""
    from ..operators import chunking

    chunks = storage.written(chunking.process_documents(files, size, overlap), "rebuilt")
    index = search.build_index(chunks)
    found = search.routes(cases, index)
    full = rerank.rerank(fused(found, ("bm25", "vector")), cases, chunks, scorer=scorer)
    summary = metrics.eval_summary(scored({"full_pipeline": full}, cases, golden, chunks))
    return summary.select(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap"), *METRICS)


def full_sweep(files: DataFrame, cases: DataFrame, golden: DataFrame, sizes=(256, 512, 1024), overlaps=(64, 128, 256), scorer=None) -> DataFrame:
    """(chunk_size, overlap, each metric) for each pair with overlap < size, as an
    index built for each would give it, in one pass: see ``plans.sweep``."""
    from . import sweep

    pairs = [(s, o) for s in sizes for o in overlaps if o < s]
    chunks, found = sweep.search(files, cases.select("query_id", "query"), pairs, scorer)
    rows = found.join(chunks.select("chunk_id", "source"), "chunk_id").select(F.col("query_id.config").cast("string").alias("stage"), F.col("query_id.query_id").alias("query_id"), "rank", "source")
    named = chunks.sparkSession.createDataFrame([(str(i), i, *p) for i, p in enumerate(pairs)], "stage string, ordinal int, chunk_size int, overlap int")
    scores = storage.written(metrics.per_query(rows, golden, named, cases), "scores")
    return metrics.eval_summary(scores).join(named, "stage").select("chunk_size", "overlap", *METRICS)


def best_config(sweep: DataFrame, *order: str) -> DataFrame:
    """The first configuration, by the columns named, of the highest MRR."""
    return sweep.orderBy(F.desc("mrr"), *order).limit(1)


def latency_profile(cases: DataFrame, index: search.Index, scorer=None, runs: int = 3, batches: int = 1) -> DataFrame:
    """(stage, mean_ms, min_ms, max_ms) a query, and their total: cases are dealt to
    so many batches, each stage of a batch is run ``runs`` times, and its time shared
    by the batch's queries; as many batches as cases time each query alone."""
    rows = []
    cases = storage.written(cases.withColumn("__batch", (F.row_number().over(metrics.W.orderBy("query_id")) - 1) % batches), "profiled")  # a set of cases
    parts = [cases.filter(F.col("__batch") == b).drop("__batch") for b in range(batches)]

    def timed(stage: str, made: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        out = storage.written(made(), "timed")  # a plan's making runs jobs of its own
        rows.append((stage, (time.perf_counter() - began) * 1000 / n))
        return out

    for part in parts * runs:
        n = part.count()
        if not n:
            continue
        found = {name: timed(f"{name}_search_ms", made) for name, made in search.plans(part, index).items()}
        both = timed("rrf_fusion_ms", lambda: ranking.rrf(ranking.append_routes(*found.values())))  # noqa: B023
        timed("ce_rerank_ms", lambda: rerank.rerank(both, part, index.chunks, scorer=scorer))  # noqa: B023
    return metrics.latency_stats(cases.sparkSession.createDataFrame(rows, "stage string, ms double"))


def query_deep_dive(found: dict[str, DataFrame], cases: DataFrame, golden: DataFrame, chunks: DataFrame, ids: list, scorer=None, k: int = 5) -> DataFrame:
    """(query_id, stage, rank, score, source, headings, relevant, preview, mrr): the
    first k rows of each stage for the cases named, with the stage's MRR."""
    some = cases.filter(F.col("query_id").isin(ids))
    own = {n: found[n].join(some.select("query_id"), "query_id", "left_semi").filter(F.col("rank") <= k) for n in ("bm25", "vector")}
    own["rrf"] = fused(own, ("bm25", "vector"))
    own["cross_encoder"] = rerank.rerank(own["rrf"], some, chunks, scorer=scorer)
    scores = scored(own, some, golden, chunks).select("stage", "query_id", F.round("mrr", 4).alias("mrr"))
    head = F.coalesce(F.col("heading_breadcrumb"), F.lit("")) if "heading_breadcrumb" in chunks.columns else F.lit("")
    rows = None
    for name, r in own.items():
        part = r.filter(F.col("rank") <= k).select(F.lit(name).alias("stage"), "query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.join(chunks.select("chunk_id", "source", head.alias("headings"), F.substring("content", 1, 80).alias("preview")), "chunk_id")
    return metrics.judged(rows, golden).join(scores, ["stage", "query_id"]).select("query_id", "stage", "rank", "score", "source", "headings", "relevant", "preview", "mrr")


# ------------------------------------------------------------------- judges


def evaluate_answers(cases: DataFrame, index: search.Index, model: agent.Model | None, *, scorer=None, found: DataFrame | None = None) -> DataFrame:
    """Each case retrieved, answered and judged: (query_id, query, category, answer,
    context, golden_answer, faithfulness, relevancy, context_recall)."""
    made = storage.written(agent.retrieve_and_generate(cases, index, model, scorer=scorer, found=found), "answers")
    rows = cases.join(made, "query_id")
    for kind in ("faithfulness", "relevancy", "context_recall"):
        rows = agent.judge(rows, kind, model)
    return rows.select("query_id", "query", "category", F.substring("answer", 1, 800).alias("answer"), F.substring("context", 1, 1000).alias("context"), "golden_answer", "faithfulness", "relevancy", "context_recall")


def run_llm_evaluation(cases: DataFrame, index: search.Index, model: agent.Model | None, *, scorer=None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(details, summary by judge, overall and by category)."""
    details = storage.written(evaluate_answers(cases, index, model, scorer=scorer, found=found), "judged")
    scores = details.select("query_id", "category", F.col("faithfulness.score").alias("faithfulness"), F.col("relevancy.score").alias("relevancy"), F.col("context_recall.score").alias("recall"))
    return details, metrics.judge_summary(scores)


def run_quick_check(cases: DataFrame, index: search.Index, model: agent.Model | None, n: int = 3) -> DataFrame | None:
    """The first n cases' details if the model answers at all, else None."""
    spark = cases.sparkSession
    probe = agent.call_model(spark.createDataFrame([("Reply with OK.",)], "prompt string"), "prompt", "said", model, attempts=1).first()
    return evaluate_answers(cases.orderBy("query_id").limit(n), index, model) if probe.said else None


def evaluate_rewrites(cases: DataFrame, golden: DataFrame, index: search.Index, model: agent.Model | None = None, scorer=None) -> DataFrame:
    """A row a case: its query and the rewritten one, searched and reranked alike,
    with the gains of the one on the other, and how well the sense was kept."""
    pairs = storage.written(agent.rewrite_query(cases.select("query_id", "query"), model), "rewritten")
    asked = {"original": pairs.select("query_id", "query"), "rewritten": pairs.select("query_id", F.col("rewritten").alias("query"))}
    found = {}
    for name, q in asked.items():
        both = fused(search.routes(q, index), ("bm25", "vector"))
        found[name] = storage.written(rerank.rerank(both, q, index.chunks, scorer=scorer), "reranked")
    scores = scored(found, cases, golden, index.chunks)
    best = found["original"].filter("rank = 1").select("query_id", F.round("score", 4).alias("best"))
    rows = cases.select("query_id", "category").join(agent.judge(pairs, "fidelity", model), "query_id").join(best, "query_id", "left")
    for name in asked:
        own = scores.filter(F.col("stage") == name)
        rows = rows.join(own.select("query_id", *[F.col(m).alias(f"{m}_{name}") for m in METRICS]), "query_id")
    gain = lambda m: F.round(F.col(f"{m}_rewritten") - F.col(f"{m}_original"), 4)
    shown = [F.round(f"{m}_{name}", 4).alias(f"{m}_{name}") for m in METRICS for name in asked]
    return rows.select("query_id", "category", F.col("query").alias("original_query"), F.col("rewritten").alias("rewritten_query"), F.coalesce("best", F.lit(0.0)).alias("ce_score_original"), *shown, gain("mrr").alias("delta_mrr"), gain("hit").alias("delta_hit"), gain("precision").alias("delta_precision"), F.col("fidelity.score").alias("fidelity_score"), F.col("fidelity.reason").alias("fidelity_reason"), (gain("mrr") > 0).alias("helpful"))


def calibrate_threshold(rewrites: DataFrame, low: float = 1.0, high: float = 6.0, step: float = 0.5) -> DataFrame:
    """One row: the threshold whose cases below it are best those that a rewrite
    helps, its F1, the cases, and whether they are enough to trust it."""
    spark = rewrites.sparkSession
    steps = spark.range(int(round((high - low) / step)) + 1).select((F.col("id") * step + low).alias("threshold"))
    cases = storage.written(rewrites.select(F.col("ce_score_original").alias("score"), "helpful"), "calibration")
    best = metrics.calibrated(metrics.confusion_sweep(cases, steps), params.CE_THRESHOLD)
    n = cases.agg(F.count("*").alias("cases"))
    return best.crossJoin(n).withColumn("confidence", F.when(F.col("cases") < params.LOW_CASES, "low").otherwise("normal"))  # one row each


# -------------------------------------------------------------- knowledge graph


def kg_diagnostics(cases: DataFrame, golden: DataFrame, chunks: DataFrame, triples: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(cases, summary): what the knowledge graph alone finds for each case, with
    the entities asked for, the nodes they match and the rank of the first golden
    source; MRR and hits in the first k by category and overall."""
    named = cases.select("query_id", F.col("query").alias("content"))
    wanted = entity_graph.entities(named, params.KG_QUERY_ENTITIES, "query_id").select("query_id", "entity")
    asked = storage.written(wanted.select("query_id", T.normalize_entity_kg_query(F.col("entity")).alias("entity")).distinct(), "kg-asked")
    graph = storage.written(kg.edges(triples), "kg-edges")
    nodes = graph.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
    found = storage.written(kg.search(asked, triples, chunks, k), "kg-found")
    rows = results({"kg": found}, chunks)
    ranks = metrics.hit_rank(rows, golden).select("query_id", "hit_rank")
    listed = lambda df, c, order, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]).alias(name))
    top = found.join(chunks.select("chunk_id", "source"), "chunk_id").select("query_id", "rank", "source", F.round("score", 4).alias("score"))
    out = cases.select("query_id", "category", "query")
    for part in (listed(asked.withColumn("o", F.col("entity")), "entity", "o", "query_entities"), listed(kg.match_nodes(asked, nodes).withColumn("o", F.col("node")), "node", "o", "matched_nodes"), listed(top, "source", "rank", "top_sources"), listed(top, "score", "rank", "top_scores"), ranks):
        out = out.join(part, "query_id", "left")
    scores = scored({"kg": found}, cases, golden, chunks)
    return out, metrics.diag_by_category(scores, cases.select("query_id", "category"))


def build_control_triples(records: DataFrame, clean: DataFrame) -> DataFrame:
    """The triple records of clean sources (source)."""
    return records.join(clean.select(F.col("source").alias("source_doc")), "source_doc", "left_semi").select(*records.columns)


def kg_control(cases: DataFrame, golden: DataFrame, chunks: DataFrame, records: DataFrame, clean: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The diagnostics over clean sources alone: cases whose golden sources are all
    clean, clean chunks, and triples of clean documents."""
    usable = metrics.filter_golden_subset(golden, clean).select("query_id")
    own = chunks.join(clean.select("source"), "source", "left_semi")
    triples = storage.written(kg.clean_triples(build_control_triples(records, clean)), "control-triples")
    return kg_diagnostics(cases.join(usable, "query_id", "left_semi"), golden, own, triples, k)
