"""Rankings: (query_id, chunk_id, route, rank, score), always in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params


def rank(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def top_k(scores: DataFrame, k: int, route: str) -> DataFrame:
    """The k best of each query; the limit is pushed below the window's sort."""
    return rank(scores).filter(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(route).alias("route"), "rank", "score")


def normalize_by_max(r: DataFrame) -> DataFrame:
    """Scores over the query's highest; queries whose highest isn't positive drop out."""
    top = F.max("score").over(W.partitionBy("query_id"))
    return r.withColumn("top", top).filter("top > 0").withColumn("score", F.col("score") / F.col("top")).drop("top")


def minmax_normalize(r: DataFrame) -> DataFrame:
    """Scores onto [0, 1] by query and route; constant lists stay as they are."""
    w = W.partitionBy("query_id", "route")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return r.withColumns({"lo": lo, "hi": hi}).withColumn("score", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("score"))).drop("lo", "hi")


def append_routes(*routes: DataFrame) -> DataFrame:
    out = routes[0]
    for r in routes[1:]:
        out = out.unionByName(r)
    return out


def dedup_concat(*routes: DataFrame) -> DataFrame:
    """Normalised routes in one list, each chunk once with its best score."""
    rows = minmax_normalize(append_routes(*routes))
    best = rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return rank(best).select("query_id", "chunk_id", F.lit("concat").alias("route"), "rank", "score")


def rrf(routes: DataFrame, weights: dict[str, float] | None = None, k: int = params.RRF_K, top_n: int | None = None, order: tuple[str, ...] = ("bm25", "vector", "graph", "kg")) -> DataFrame:
    """Weighted reciprocal rank fusion over (query_id, chunk_id, route, rank).
    Weights go by route name, 1 where none is given; a missing route adds
    nothing. Ties keep the order of first sight: route, then rank, then id."""
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("route") == name, F.lit(float(value))).otherwise(weight)
    place = F.lit(len(order))
    for i, name in enumerate(order):
        place = F.when(F.col("route") == name, F.lit(i)).otherwise(place)
    seen = F.min(F.struct(place.alias("place"), F.col("rank").alias("first_rank"), F.col("route").alias("first_route")))
    fused = routes.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 6).alias("score"), seen.alias("seen"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "seen.place", "seen.first_rank", "chunk_id")
    out = fused.withColumn("rank", F.row_number().over(w)).select("query_id", "chunk_id", F.lit("rrf").alias("route"), "rank", "score", F.col("seen.first_route").alias("original_source"))
    return out.filter(F.col("rank") <= top_n) if top_n else out


def route_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, n_both, n_either) of two routes' chunks."""
    marked = a.select("query_id", "chunk_id", F.lit(1).alias("side")).unionByName(b.select("query_id", "chunk_id", F.lit(2).alias("side")))
    each = marked.groupBy("query_id", "chunk_id").agg(F.countDistinct("side").alias("sides"))
    return each.groupBy("query_id").agg(F.count_if(F.col("sides") == 2).alias("n_both"), F.count("*").alias("n_either"))


def first_k_context(r: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, context): the first k chunks in rank order, under their sources."""
    rows = r.filter(F.col("rank") <= k).join(chunks.select("chunk_id", "source", "content"), "chunk_id")
    part = F.concat(F.lit("[来源"), F.col("rank").cast("string"), F.lit(": "), F.coalesce("source", F.lit("unknown")), F.lit("] "), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("context"))


def ordered_dedup(rows: DataFrame, value: str, order: str = "position") -> DataFrame:
    """Each query's values at their first place only: (query_id, value, position)."""
    return rows.groupBy("query_id", value).agg(F.min(order).alias(order))
