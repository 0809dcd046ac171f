"""Search as one lazy plan over all queries, and the tools built on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params, storage
from ..functions import text as T
from ..operators import bm25, entity_graph, kg, ranking, rerank, vector


@dataclass
class Index:
    """What is built once: chunks (chunk_id, source, content), words, vectors, and
    the optional graph and triples. No route reads the graph's edges, which are many
    times its entities: they are a plan, and a table only where an index is stored."""

    chunks: DataFrame
    vectors: DataFrame
    words: bm25.Index
    entities: DataFrame | None = None
    edges: DataFrame | None = None
    triples: DataFrame | None = None


def build_index(chunks: DataFrame, graph: bool = False, triples: DataFrame | None = None) -> Index:
    words = bm25.build(chunks)
    ec = storage.written(entity_graph.entities(chunks, post=words.postings), "entities") if graph else None
    vectors = storage.written(vector.embed(chunks), "vectors")
    return Index(chunks, vectors, words, ec, entity_graph.cooccurrence(ec) if graph else None, triples)


def _tables(index: Index) -> dict[str, DataFrame | None]:
    words = {"postings": index.words.postings, "terms": index.words.terms, "stats": index.words.stats}
    return {"chunks": index.chunks, "vectors": index.vectors, **words, "entities": index.entities, "edges": index.edges, "triples": index.triples}


def ensure_index(spark: SparkSession, path: str, chunks: DataFrame, graph: bool = False, triples: DataFrame | None = None) -> Index:
    """The index at ``path``; it is built and stored there first if it isn't whole.
    A marker is written last, so what a lost run has left is not taken for one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/whole")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        parts = _tables(build_index(chunks, graph, triples))
        for name, df in parts.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(n,) for n, df in parts.items() if df is not None], "name string").write.mode("overwrite").parquet(f"{path}/whole")
    held = {r.name for r in spark.read.parquet(f"{path}/whole").collect()}  # the tables' names
    read = lambda n: spark.read.parquet(f"{path}/{n}") if n in held else None
    return Index(read("chunks"), read("vectors"), bm25.Index(read("postings"), read("terms"), read("stats")), read("entities"), read("edges"), read("triples"))


def plans(queries: DataFrame, index: Index) -> dict[str, Callable[[], DataFrame]]:
    """What makes the rankings of each route the index has. A route counts, collects
    and writes while its plan is made, so who times one must time the call as well."""
    asked = lambda: vector.embed(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("content"))).select(F.col("chunk_id").alias("query_id"), "vec")
    out = {"bm25": lambda: bm25.search(queries, index.words), "vector": lambda: vector.search(asked(), index.vectors)}

    @cache
    def wanted() -> DataFrame:
        named = queries.select("query_id", F.col("query").alias("content"))
        return entity_graph.entities(named, params.KG_QUERY_ENTITIES, "query_id").select("query_id", "entity")

    if index.entities is not None:
        out["graph"] = lambda: entity_graph.search(queries, index.entities, wanted())
    if index.triples is not None:
        out["kg"] = lambda: kg.search(wanted().select("query_id", T.normalize_entity_kg_query(F.col("entity")).alias("entity")).distinct(), index.triples, index.chunks)
    return out


def routes(queries: DataFrame, index: Index) -> dict[str, DataFrame]:
    """The rankings of every route the index has, for all queries at once."""
    return {name: made() for name, made in plans(queries, index).items()}


def fusion_pipeline(found: dict[str, DataFrame], queries: DataFrame, chunks: DataFrame, weights: dict[str, float] | None = None, rrf_k: int = params.RRF_K, ce_top_k: int = params.CE_TOP_K, scorer=None) -> dict[str, DataFrame]:
    """{rrf, cross_encoder}: all routes fused, then every fused row rescored."""
    fused = ranking.rrf(ranking.append_routes(*found.values()), weights or {"graph": params.GRAPH_RRF_WEIGHT, "kg": params.KG_RRF_WEIGHT}, rrf_k)
    fused = storage.written(fused, "fused")  # at most the routes' top k of each query; read by both stages
    return {"rrf": fused, "cross_encoder": rerank.rerank(fused, queries, chunks, ce_top_k, scorer)}


def stages(queries: DataFrame, index: Index, scorer=None) -> dict[str, DataFrame]:
    """The ranking of every stage, as a front end shows them side by side: the
    routes that the index has, their fusion, and the reranked rows."""
    found = routes(queries, index)
    return {**found, **fusion_pipeline(found, queries, index.chunks, scorer=scorer)}


def search_knowledge(queries: DataFrame, index: Index, top_k: int = params.CE_TOP_K, scorer=None) -> DataFrame:
    """The tool's rows: ranked chunks with source, preview and scores."""
    done = fusion_pipeline(routes(queries, index), queries, index.chunks, ce_top_k=top_k, scorer=scorer)
    found = done["cross_encoder"].join(done["rrf"].select("query_id", "chunk_id", F.col("score").alias("rrf_score"), "original_source"), ["query_id", "chunk_id"])
    return tool_projection(found, index.chunks)


def tool_projection(found: DataFrame, chunks: DataFrame) -> DataFrame:
    rows = found.join(chunks.select("chunk_id", "source", "content"), "chunk_id")
    return rows.select("query_id", "rank", "chunk_id", F.coalesce("source", F.lit("unknown")).alias("source"), T.truncate_text(F.col("content")).alias("content"), F.round("score", 4).alias("ce_score"), F.round("rrf_score", 6).alias("rrf_score"), "original_source")


def list_documents(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks")).orderBy("source")


def get_chunk(chunks: DataFrame, chunk_id) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id).limit(1)


def get_chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"))
