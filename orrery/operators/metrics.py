"""Retrieval quality: ranked results against golden sources, and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged(results: DataFrame, golden: DataFrame) -> DataFrame:
    """results (stage, query_id, rank, source) with ``relevant``; golden has
    (query_id, source), each pair once."""
    marks = golden.select("query_id", "source").distinct().withColumn("hit", F.lit(True))
    return results.join(marks, ["query_id", "source"], "left").withColumn("relevant", F.coalesce("hit", F.lit(False))).drop("hit")


def golden_semi(results: DataFrame, golden: DataFrame) -> DataFrame:
    return results.join(golden, ["query_id", "source"], "left_semi")


def per_query(results: DataFrame, golden: DataFrame, stages: DataFrame, queries: DataFrame, k: int = 5, mrr_k: int = 10) -> DataFrame:
    """(stage, query_id, mrr, hit, precision, recall) for every stage and query,
    zero where nothing was returned. Precision divides by what was returned, up
    to k; recall counts distinct golden sources."""
    rows = judged(results, golden)
    seen = F.col("rank") <= k
    agg = rows.groupBy("stage", "query_id").agg(
        F.min(F.when(F.col("relevant") & (F.col("rank") <= mrr_k), F.col("rank"))).alias("first"),
        F.count_if(seen & F.col("relevant")).alias("hits"),
        F.count_if(seen).alias("returned"),
        F.countDistinct(F.when(seen & F.col("relevant"), F.col("source"))).alias("found"),
    )
    sizes = golden.select("query_id", "source").distinct().groupBy("query_id").agg(F.count("*").alias("n_golden"))
    grid = queries.select("query_id").crossJoin(F.broadcast(stages.select("stage")))  # a few stages
    full = grid.join(agg, ["stage", "query_id"], "left").join(sizes, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return full.select(
        "stage", "query_id", zero(1 / F.col("first")).alias("mrr"), (F.coalesce("hits", F.lit(0)) > 0).cast("double").alias("hit"),
        zero(F.try_divide(F.col("hits"), F.col("returned"))).alias("precision"), zero(F.try_divide(F.col("found"), F.col("n_golden"))).alias("recall"),
    )


def means(names=("mrr", "hit", "precision", "recall")):
    return [F.round(F.avg(m), 4).alias(m) for m in names]


def eval_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("stage").agg(*means())


def category_breakdown(scores: DataFrame, categories: DataFrame, names=("bm25", "vector", "rrf")) -> DataFrame:
    """A row a category: MRR of each stage, and what the last gains on the best other."""
    rows = scores.join(categories, "query_id").groupBy("category").pivot("stage", list(names)).agg(F.avg("mrr"))
    cols = [F.round(F.coalesce(n, F.lit(0.0)), 4).alias(f"mrr_{n}") for n in names]
    rest = F.greatest(*[F.coalesce(n, F.lit(0.0)) for n in names[:-1]])
    return rows.select("category", *cols, F.round(F.coalesce(names[-1], F.lit(0.0)) - rest, 4).alias("gain"))


def diag_by_category(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """Counts, MRR and hit rate by category, and overall, in one rollup."""
    rows = scores.join(categories, "query_id").rollup("category").agg(F.count("*").alias("n"), *means(("mrr", "hit")))
    return rows.withColumn("category", F.coalesce("category", F.lit("overall")))


def ablation_delta(summary: DataFrame, order: DataFrame) -> DataFrame:
    """(stage, mrr, delta): the gain on the stage before; the first has none."""
    w = W.orderBy("ordinal")  # a row a configuration
    rows = summary.join(order, "stage")
    return rows.select("stage", "ordinal", "mrr", F.round(F.col("mrr") - F.coalesce(F.lag("mrr").over(w), F.col("mrr")), 4).alias("delta"))


def hit_rank(results: DataFrame, golden: DataFrame) -> DataFrame:
    return judged(results, golden).filter("relevant").groupBy("stage", "query_id").agg(F.min("rank").alias("hit_rank"))


def confusion_sweep(cases: DataFrame, thresholds: DataFrame) -> DataFrame:
    """cases (score, helpful) against thresholds: a score below one predicts helpful."""
    rows = cases.crossJoin(F.broadcast(thresholds))  # a few thresholds
    yes, would = F.col("helpful"), F.col("score") < F.col("threshold")
    out = rows.groupBy("threshold").agg(F.count_if(yes & would).alias("tp"), F.count_if(~yes & would).alias("fp"), F.count_if(~yes & ~would).alias("tn"), F.count_if(yes & ~would).alias("fn"))
    p, r = (F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    out = out.withColumn("p", p).withColumn("r", r)
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return out.select("threshold", "tp", "fp", "tn", "fn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def argmax_config(configs: DataFrame, metric: str, ordinal: str) -> DataFrame:
    """The first configuration, in order, of the highest metric."""
    return configs.orderBy(F.desc(metric), ordinal).limit(1)


def calibrated(sweep: DataFrame, default: float) -> DataFrame:
    """The first threshold of the best F1; the default if none is above zero."""
    best = argmax_config(sweep.filter("f1 > 0"), "f1", "threshold").agg(F.first("threshold").alias("t"), F.first("f1").alias("f"))
    return best.select(F.coalesce("t", F.lit(default)).alias("threshold"), F.coalesce("f", F.lit(0.0)).alias("f1"))


def latency_stats(timings: DataFrame) -> DataFrame:
    """(stage, mean_ms, min_ms, max_ms) and a total of the means."""
    each = timings.groupBy("stage").agg(F.avg("ms").alias("m"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))
    total = each.agg(F.lit("total").alias("stage"), F.sum("m").alias("m"), F.lit(None).cast("double").alias("min_ms"), F.lit(None).cast("double").alias("max_ms"))
    return each.unionByName(total).select("stage", F.round("m", 2).alias("mean_ms"), F.round("min_ms", 2).alias("min_ms"), F.round("max_ms", 2).alias("max_ms"))


def judge_summary(scores: DataFrame) -> DataFrame:
    """scores (query_id, category, faithfulness, relevancy, recall): mean, least
    and most of each judge by category and overall."""
    long = scores.unpivot(["query_id", "category"], ["faithfulness", "relevancy", "recall"], "judge", "score")
    rows = long.rollup("judge", "category").agg(F.avg("score").alias("m"), F.min("score").alias("lo"), F.max("score").alias("hi")).filter("judge is not null")
    return rows.select("judge", F.coalesce("category", F.lit("overall")).alias("category"), F.round("m", 4).alias("mean"), F.round("lo", 4).alias("least"), F.round("hi", 4).alias("most"))


def rewrite_summary(cases: DataFrame) -> DataFrame:
    """cases (category, delta): helped, degraded, unchanged, rates and deltas."""
    d = F.col("delta")
    return cases.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(d > 0).alias("helpful"), F.count_if(d < 0).alias("degraded"), F.count_if(d == 0).alias("unchanged"),
        F.round(F.avg((d > 0).cast("double")), 4).alias("helpful_rate"), F.round(F.avg(d), 4).alias("mean_delta"),
        F.round(F.max(F.when(d != 0, d)), 4).alias("max_delta"), F.round(F.min(F.when(d != 0, d)), 4).alias("min_delta"),
    )


def sweep_grid(sizes: DataFrame, overlaps: DataFrame) -> DataFrame:
    return sizes.crossJoin(F.broadcast(overlaps)).filter("overlap < size")


def filter_golden_subset(golden: DataFrame, clean: DataFrame) -> DataFrame:
    """Queries whose golden sources are all clean."""
    marks = golden.join(clean.select("source", F.lit(1).alias("ok")), "source", "left")
    return marks.groupBy("query_id").agg(F.min(F.coalesce("ok", F.lit(0))).alias("all_ok"), F.count("*").alias("n_golden")).filter("all_ok = 1").select("query_id", "n_golden")
