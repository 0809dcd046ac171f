"""The directed knowledge graph: cleaned triples, paths, chunk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params, storage
from ..functions import text as T
from . import entity_graph, ranking


def clean_triples(records: DataFrame) -> DataFrame:
    """(chunk_id, source_doc, subject, relation, object) of (chunk_id,
    source_doc, triples): blank fields and numeric relations go, long relations
    are cut, ends are normalised and checked."""
    rows = records.select("chunk_id", "source_doc", F.explode("triples").alias("t")).select("chunk_id", "source_doc", "t.*")
    for c in ("subject", "relation", "object"):
        rows = rows.filter(F.col(c).isNotNull() & F.col(c).rlike(r"(?U)\S"))
    relation = F.regexp_replace("relation", r"(?U)^\s+|\s+$", "")
    rows = rows.withColumn("relation", relation).filter(~F.col("relation").rlike("(?U)" + T.NUMERIC)).withColumn("relation", F.substring("relation", 1, params.RELATION_CHARS))
    rows = rows.withColumns({c: T.normalize_entity_kg_query(F.col(c)) for c in ("subject", "object")})
    rows = storage.written(rows, "kg-normalised")  # else each check of an end normalises it again
    return rows.filter(T.is_valid_entity(F.col("subject"), graph=False) & T.is_valid_entity(F.col("object"), graph=False)).select("chunk_id", "source_doc", "subject", "relation", "object")


def edges(triples: DataFrame) -> DataFrame:
    """(subject, object, relations): relations distinct, in a fixed order."""
    return triples.groupBy("subject", "object").agg(F.array_sort(F.collect_set("relation")).alias("relations"))


def entity_chunk_index(triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity, chunk_id): by the triple's chunk, or, where that is unknown, by
    all chunks of its source."""
    ends = triples.select("chunk_id", "source_doc", F.explode(F.array("subject", "object")).alias("entity")).distinct()
    known = ends.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("entity", "chunk_id")
    lost = ends.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("entity", "source_doc").distinct()
    by_source = lost.join(chunks.select(F.col("source").alias("source_doc"), "chunk_id"), "source_doc").select("entity", "chunk_id")
    return known.unionByName(by_source).distinct()


def match_nodes(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node): equal names, else those that contain each other."""
    names = nodes.select(F.col("entity").alias("node"))
    exact = asked.join(names, asked["entity"] == names["node"]).select("query_id", "entity", "node")
    left = storage.written(asked.join(exact.select("query_id", "entity"), ["query_id", "entity"], "left_anti"), "kg-left")
    open_ = left.select("entity").distinct()
    inside = entity_graph.contained(open_.select(F.col("entity").alias("s")), names.select(F.col("node").alias("l"))).select(F.col("s").alias("entity"), F.col("l").alias("node"))
    around = entity_graph.contained(names.select(F.col("node").alias("s")), open_.select(F.col("entity").alias("l"))).select(F.col("l").alias("entity"), F.col("s").alias("node"))
    within = left.join(inside.unionByName(around).distinct(), "entity")
    return storage.written(exact.select("query_id", "node").unionByName(within.select("query_id", "node")).distinct(), "kg-matched")


#: Targets of a block are bits of so many longs: the columns of ``_MARKS``.
WORDS = 8
_MARKS = [f"m{i}" for i in range(WORDS)]
_SET = [f"if(place div 64 = {i}, shiftleft(1L, cast(place % 64 as int)), 0L) as {m}" for i, m in enumerate(_MARKS)]
_PLACES = f"explode(filter(sequence(0, {64 * WORDS - 1}), p -> (shiftrightunsigned(element_at(array({', '.join(_MARKS)}), cast(p div 64 as int) + 1), p % 64) & 1L) = 1L)) as place"
_ANY = " or ".join(f"{m} <> 0" for m in _MARKS)


def _together(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys as one, with the bits of all."""
    return rows.groupBy(*keys).agg(*[F.bit_or(m).alias(m) for m in _MARKS])


def _common(a: DataFrame, b: DataFrame, on: list[str], but: bool = False) -> DataFrame:
    """a's rows with the bits that b's rows of equal keys have too, or, with ``but``, have not."""
    rows = a.join(b.select(*on, *[F.col(m).alias(f"b{m}") for m in _MARKS]), on, "left" if but else "inner")
    held = {m: F.col(m).bitwiseAND(F.bitwise_not(F.coalesce(f"b{m}", F.lit(0).cast("long"))) if but else F.col(f"b{m}")) for m in _MARKS}
    return rows.withColumns(held).drop(*[f"b{m}" for m in _MARKS]).filter(_ANY)


def paths(matched: DataFrame, graph: DataFrame, max_hop: int = params.KG_MAX_HOP) -> DataFrame:
    """(query_id, source, target, mid, inner): ordered pairs of a query's matched
    nodes that a path of at most max_hop edges joins, with the inner nodes of the
    shortest one (of several, that whose nodes sort first) and the first of these.

    What a node reaches depends on no query, so each matched node is one bit, and
    every round writes for each node the bits that it reaches: a row of ``WORDS`` longs
    for a block of targets, where rows of (query, source, node) with their paths would
    soon be all nodes for each of them. A source's pairs are the bits that are new to it
    and stand for nodes of a query that it shares: pairs that no path joins are
    never made. Paths are then walked from the sources, all at once, by the first
    neighbour that reaches the target in what is left of the way."""
    e = storage.written(graph.select("subject", "object").distinct(), "path-edges")
    asked = storage.written(matched.select("query_id", "node").distinct(), "path-asked")
    names = asked.select("node").distinct().filter("node is not null")
    names = names.repartition(1 + names.count() // (1 << 16)).withColumn("id", F.monotonically_increasing_id())  # whole blocks, but for the last of each partition
    names = storage.written(names.select("node", F.expr(f"id div {64 * WORDS}").alias("block"), F.expr(f"cast(id % {64 * WORDS} as int)").alias("place")), "path-names")
    own = names.selectExpr("node", "block", *_SET)
    held = _together(asked.join(own, "node"), "query_id", "block")
    partners = storage.written(_together(asked.join(held, "query_id"), "node", "block"), "path-partners")
    reach, pairs = [storage.written(own, "path-reach")], {}
    for hops in range(1, max_hop + 1):
        step = e if hops < max_hop else e.join(names.select(F.col("node").alias("subject")), "subject", "left_semi")  # the last is asked of sources only
        further = step.join(reach[-1].withColumnRenamed("node", "object"), "object").select(F.col("subject").alias("node"), "block", *_MARKS)
        reach.append(storage.written(_together(further.unionByName(reach[-1]), "node", "block"), "path-reach"))
        met = _common(_common(partners, reach[hops], ["node", "block"]), reach[hops - 1], ["node", "block"], but=True)
        met = met.selectExpr("node as source", "block", _PLACES, "node as at", "cast(array() as array<string>) as inner")
        pairs[hops] = storage.written(met, "path-met")
    walked = None
    for left in range(max_hop, 0, -1):  # edges between a path's end so far and its target
        walked = pairs[left] if walked is None else walked.unionByName(pairs[left])
        if left > 1:
            walked = storage.written(_walked(walked, e, reach[left - 1]), "path-walked")
    if walked is None:
        return asked.select("query_id", F.col("node").alias("source"), F.col("node").alias("target"), F.col("node").alias("mid"), F.array("node").alias("inner")).limit(0)
    found = storage.written(walked.join(names.withColumnRenamed("node", "target"), ["block", "place"]).select("source", "target", "inner"), "path-found")
    ends = lambda name: asked.select("query_id", F.col("node").alias(name))
    found = found.join(ends("source"), "source").join(ends("target"), ["query_id", "target"])
    return found.select("query_id", "source", "target", F.get("inner", F.lit(0)).alias("mid"), "inner")


def _walked(open_: DataFrame, e: DataFrame, reach: DataFrame) -> DataFrame:
    """Paths (source, block, place, at, inner) with the first node behind ``at`` that reaches their target."""
    wanted = _together(open_.select("at", "block", "place").distinct().selectExpr("at", "block", *_SET), "at", "block")
    behind = wanted.join(e.select(F.col("subject").alias("at"), F.col("object").alias("node")), "at")
    hits = _common(behind, reach, ["node", "block"]).selectExpr("at", "block", _PLACES, "node")
    first = hits.groupBy("at", "block", "place").agg(F.min("node").alias("next"))
    return open_.join(first, ["at", "block", "place"]).select("source", "block", "place", F.col("next").alias("at"), F.concat("inner", F.array("next")).alias("inner"))


def relevant_entities(matched: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, entity, weight): matched nodes 1.0, nodes on paths 0.5."""
    direct = matched.select("query_id", F.col("node").alias("entity"), F.lit(1.0).alias("weight"))
    between = found.select("query_id", F.explode("inner").alias("entity"), F.lit(0.5).alias("weight"))
    return direct.unionByName(between).groupBy("query_id", "entity").agg(F.max("weight").alias("weight"))


def score_chunks(relevant: DataFrame, index: DataFrame) -> DataFrame:
    rows = relevant.join(index, "entity").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"))
    return ranking.normalize_by_max(rows).withColumn("score", F.round("score", 6))


def search(asked: DataFrame, triples: DataFrame, chunks: DataFrame, k: int = params.KG_TOP_K, max_hop: int = params.KG_MAX_HOP) -> DataFrame:
    graph = storage.written(edges(triples), "kg-edges")
    nodes = graph.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
    matched = match_nodes(asked, nodes)
    return ranking.top_k(score_chunks(relevant_entities(matched, paths(matched, graph, max_hop)), entity_chunk_index(triples, chunks)), k, "kg")


def pending_chunks(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache.select("chunk_id").distinct(), "chunk_id", "left_anti")


def filter_valid_triples(triples):
    """Triples of an array whose three fields all hold something."""
    return F.filter(triples, lambda t: (F.coalesce(t["subject"], F.lit("")) != "") & (F.coalesce(t["relation"], F.lit("")) != "") & (F.coalesce(t["object"], F.lit("")) != ""))


def load_cache(spark, path: str) -> DataFrame:
    """The triple records at path (JSON Lines), each chunk once, by its fullest record; none if nothing is there."""
    schema = "chunk_id string, source_doc string, status string, triples array<struct<subject:string,relation:string,object:string>>"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct("source_doc", "status", "triples"), F.coalesce(F.size("triples"), F.lit(0))).alias("r")).select("chunk_id", "r.*")


def build_stats(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """One row: chunks, those cached, those left, triples, records without any."""
    c = chunks.select("chunk_id").join(records.select("chunk_id", F.size("triples").alias("n")), "chunk_id", "left")
    return c.agg(F.count("*").alias("total"), F.count("n").alias("skipped"), F.count_if(F.col("n").isNull()).alias("pending"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_triples"), F.count_if(F.col("n") == 0).alias("failed"))


