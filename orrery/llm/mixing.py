"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within a source, documents are ranged by
key into segments of equal key width (the keys are uniform, so the split points
are known without sampling), sorted inside a segment, and given the sum of the
sizes before them: sums per segment are added up along each source, and a window
inside each segment adds the rest. A source's budget is then whole epochs plus a
remainder that is cut at its exact word: the document at the cut is taken in
part. No window ever holds more than a segment, or the segment sums of a source.
Sources themselves, if there are many, are range-sorted and given prefix sums in
the same way, ``SOURCE_ROWS`` to a window.

Defined results: null and empty texts have size 0; texts are counted whole, however
long, and don't move; null sources are one source, sorted last;
null and repeated ids are separate documents, ordered by key, id and size (ties
beyond that are equal rows, whose order can't show); a source of size 0 takes
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 17
#: Documents a segment holds on average, and the most segments of a source (a power of 2).
SEGMENT_ROWS = 64
MOST_SEGMENTS = 1 << 16
SOURCE_ROWS = 100_000


def before(df: DataFrame, order: list[str], rows: int, **sums) -> DataFrame:
    """df with the sums of each value over all rows before, in the given order:
    range-sorted into parts of about ``SOURCE_ROWS`` rows, whose sums are added up."""
    parts = max(1, -(-rows // SOURCE_ROWS))
    placed = common.written(df.withColumns({f"__{k}": v for k, v in sums.items()}).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "mix-parts")
    along = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    held = placed.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    ahead = held.select("__part", *[F.coalesce(F.sum(f"__{k}").over(along), F.lit(0)).alias(f"__{k}_ahead") for k in sums])
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = placed.withColumns({k: F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)) for k in sums}).join(ahead, "__part")
    return out.select(*df.columns, *[(F.col(k) + F.col(f"__{k}_ahead")).alias(k) for k in sums])


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, rows, source_size) with ``target`` added.

    Weights repeat along the sources by code point, null last. Sharing by weight
    with ceilings, the excess reshared until none is above, is water filling: a
    level L with sum(min(weight * L, ceiling)) = total. Sorted by ceiling over
    weight, the sources below the level come first; L is found where the capped
    ones' ceilings and the rest's weights meet the total."""
    sources = common.written(sources.withColumn("no_source", F.col("source").isNull()), "mix-sources")
    n = sources.count()
    ranked = before(sources, ["no_source", "source"], n, i=F.lit(1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("i") % len(weights) + 1).cast("int"))).withColumn("ceiling", most * F.col("source_size"))
    filled = before(ranked.withColumn("ratio", F.col("ceiling") / F.col("weight")), ["ratio", "i"], n, capped=F.col("ceiling"), weighed=F.col("weight"))
    whole = filled.agg((share * F.sum("source_size")).alias("total"), F.sum("weight").alias("weights"))
    filled = common.written(filled.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("weighed"))), "mix-levels")
    # the first source, in this order, that the level doesn't fill sets it
    level = filled.agg(F.min(F.when(F.col("weight") * F.col("level") <= F.col("ceiling"), F.struct("ratio", "i", "level")))["level"].alias("set"))
    return filled.crossJoin(F.broadcast(level)).select("source", "rows", "source_size", F.least("ceiling", F.coalesce(F.col("weight") * F.col("set"), F.col("ceiling"))).alias("target"))


def key_of(seed: int):
    """A document's hash-random key: 60 bits of an MD5, from 0 on."""
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each document."""
    sized = common.written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), common.word_count(F.col(text_col)).alias("size")), "mix-sizes")
    return taken_words(sized, sized, weights, share, most, seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def taken_words(rows: DataFrame, sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """rows (doc_id, source, size, ...) with source_size, target and ``taken``
    added. ``sized`` has the same (doc_id, source, size), as narrow as can be."""
    totals = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    n = F.least(F.lit(MOST_SEGMENTS), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("rows") / SEGMENT_ROWS, F.lit(1.0)))))).cast("int")
    targets = common.written(source_targets(totals, weights, share, most).withColumn("segments", n), "mix-targets")
    flat = [F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src")]

    def keyed(df: DataFrame) -> DataFrame:
        position = F.floor(F.col("key") / F.lit(float(2**60)) * F.col("segments")).cast("int")
        return df.select("*", *flat, key_of(seed).alias("key")).join(targets.select(*flat, "source_size", "target", "segments"), ["src", "no_src"]).withColumn("segment", F.least(position, F.col("segments") - 1))

    sums = keyed(sized).groupBy("src", "no_src", "segment").agg(F.sum("size").alias("held"))
    along = W.partitionBy("src", "no_src").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select("src", "no_src", "segment", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("before"))
    order = ["key", "doc_id", "size"] + (["tie"] if "tie" in rows.columns else [])
    inside = W.partitionBy("src", "no_src", "segment").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = keyed(rows).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead, ["src", "no_src", "segment"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    return placed.withColumn("taken", (epochs * F.col("size") + cut).cast("long"))


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy taken. A
    document at its source's cut is emitted up to the last word taken; the text
    moves through one shuffle, by segment."""
    rows = docs.select(F.col("doc_id"), F.col("source"), common.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), F.struct(*docs.columns).alias("row"))
    sized = common.written(rows.select("doc_id", "source", "size"), "mix-sizes")
    out = taken_words(rows, sized, **how).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size"))
    part = F.col("taken") - whole * F.col("size")
    lens = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = out.select("row", "size", F.explode(lens).alias("words"))
    # through the end of the last word taken: everything up to the next word is cut off
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, 1, F.col("words").cast("int")), "")
    return out.select(*[F.when(F.col("words") < F.col("size"), head).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
