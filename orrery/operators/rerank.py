"""Second-stage scoring: an injected scorer of (query, text) pairs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text as T
from . import ranking

Scorer = Callable[[list[str], list[str]], list[float]]


def pairs(fused: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, query, content, rank): one text lookup for all routes."""
    return fused.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "content"), "chunk_id").join(queries.select("query_id", "query"), "query_id")


def overlap_score(query, content):
    """The offline scorer: ten times the share of the query's words in the text."""
    q = F.array_distinct(T.tokenize(query))
    return F.coalesce(F.try_divide(10.0 * F.size(F.array_intersect(q, T.tokenize(content))), F.size(q)), F.lit(0.0))


def rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = params.CE_TOP_K, scorer: Scorer | None = None) -> DataFrame:
    """The k best of each query by the scorer, which sees fused rows only. A
    Python scorer gets Arrow batches; the default stays in the JVM."""
    rows = pairs(fused, queries, chunks)
    if scorer is None:
        scored = rows.select("query_id", "chunk_id", "rank", F.round(overlap_score(F.col("query"), F.col("content")), 6).alias("score"))
    else:

        def run(batches):
            for b in batches:
                got = scorer(b.column(3).to_pylist(), b.column(4).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, pa.float64())], ["query_id", "chunk_id", "rank", "score"])

        schema = rows.select("query_id", "chunk_id", "rank", F.lit(0.0).alias("score")).schema
        scored = rows.select("query_id", "chunk_id", "rank", "query", "content").mapInArrow(run, schema)
    order = ranking.W.partitionBy("query_id").orderBy(F.desc("score"), F.col("rank"), "chunk_id")
    top = scored.withColumn("ce_rank", F.row_number().over(order)).filter(F.col("ce_rank") <= k)
    return top.select("query_id", "chunk_id", F.lit("cross_encoder").alias("route"), F.col("ce_rank").alias("rank"), "score")
