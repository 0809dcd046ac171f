"""The undirected entity graph: extraction, co-occurrence, mapping, expansion, scoring."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import params, session, storage
from ..functions import text as T
from . import bm25, ranking, vector


#: Letters of a piece by which names meet.
GRAM = 3


def _top(rows: DataFrame, top_n: int, name: str) -> DataFrame:
    """The best entities of each chunk, from the chunk's own rows."""
    best = rows.groupBy(name, "entity").agg(F.max("weight").alias("weight"))
    return best.withColumn("r", F.row_number().over(W.partitionBy(name).orderBy(F.desc("weight"), "entity"))).filter(F.col("r") <= top_n).drop("r")


def entity_tfidf(chunks: DataFrame, top_n: int = params.GRAPH_ENTITY_TOP_N, name: str = "chunk_id", post: DataFrame | None = None) -> DataFrame:
    """(chunk_id, entity, weight): the best tf-idf words of each chunk, with the
    corpus's own idf in place of a segmenter's table. Words are counted once and
    written, unless the chunks' postings are given; each distinct one is normalised
    and checked once."""
    post = storage.written(bm25.postings(chunks, name), "entity-words") if post is None else post
    n = chunks.filter("content is not null").agg(F.count("*").alias("n"))
    return best_words(post, n, top_n, name)


def best_words(post: DataFrame, n: DataFrame, top_n: int = params.GRAPH_ENTITY_TOP_N, name: str = "chunk_id") -> DataFrame:
    """entity_tfidf of postings, n being one row with the number of chunks. The commonest
    words, which most postings hold, are sent to the postings, so that most of a chunk's
    words are weighed and cut where they lie; the postings of the others are shuffled."""
    words = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    words = words.select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"), T.normalize_entity_graph(F.col("term")).alias("entity"))
    words = storage.written(words, "entity-idf")
    words = storage.written(words.withColumn("valid", T.is_valid_entity(F.col("entity"))), "entity-names")
    least = _common(words)
    common = session.small(words.filter(F.col("df") > least).drop("df"))
    rows = post.join(common.filter("valid"), "term").select(name, "tf", "length", "idf", "entity")
    if least:
        rare = post.join(common.select("term"), "term", "left_anti").join(words.filter("valid"), "term")
        rows = rows.unionByName(rare.select(name, "tf", "length", "idf", "entity"))
    rows = rows.select(name, "entity", F.round(F.col("tf") / F.col("length") * F.col("idf"), 6).alias("weight"))
    # at most two words, by the case of their first letter, are one entity: twice as many
    # rows have all the best, and this limit is taken before the shuffle
    near = F.row_number().over(W.partitionBy(name).orderBy(F.desc("weight"), "entity"))
    return _top(rows.withColumn("near", near).filter(F.col("near") <= 2 * top_n), top_n, name)


def _common(words: DataFrame, most: int = params.BROADCAST_ROWS) -> int:
    """A number of chunks that at most so many words exceed, about."""
    held = words.count()
    return 0 if held <= most else words.agg(F.percentile_approx("df", 1 - 0.9 * most / held, 100_000)).first()[0]


def entity_pos_counts(chunks: DataFrame, name: str = "chunk_id") -> DataFrame:
    """(chunk_id, entity, weight): counts of name-like words (a capital inside a
    sentence, letters and digits mixed), over the chunk's highest, halved."""
    return named_weights(storage.written(named_words(chunks, name), "entity-named"), name)


def named_words(chunks: DataFrame, name: str = "chunk_id") -> DataFrame:
    """(chunk_id, entity, n): name-like words of each chunk and how often it has them."""
    found = F.regexp_extract_all("content", F.lit(r"(?:(?<=[\p{L},;] )\p{Lu}\p{L}+|\b\p{L}+\p{N}[\p{L}\p{N}]*)"), F.lit(0))
    return chunks.select(name, F.explode(T.counted(F.coalesce(found, F.array().cast("array<string>")))).alias("t")).select(name, T.normalize_entity_graph(F.col("t.word")).alias("entity"), F.col("t.n").alias("n"))


def named_weights(words: DataFrame, name: str = "chunk_id") -> DataFrame:
    count = words.filter(T.is_valid_entity(F.col("entity"))).groupBy(name, "entity").agg(F.sum("n").alias("n"))
    return count.select(name, "entity", F.round(F.col("n") / F.max("n").over(W.partitionBy(name)) * params.POS_COEFFICIENT, 6).alias("weight"))


def entities(chunks: DataFrame, top_n: int = params.GRAPH_ENTITY_TOP_N, name: str = "chunk_id", post: DataFrame | None = None) -> DataFrame:
    return _top(entity_tfidf(chunks, top_n, name, post).unionByName(entity_pos_counts(chunks, name)), top_n, name)


def entities_of(post: DataFrame, named: DataFrame, n: DataFrame, top_n: int = params.GRAPH_ENTITY_TOP_N) -> DataFrame:
    """The entities of chunks whose postings, name-like words and number are stored."""
    return _top(best_words(post, n, top_n).unionByName(named_weights(named)), top_n, "chunk_id")


def entity_nodes(ec: DataFrame) -> DataFrame:
    return ec.groupBy("entity").agg(F.round(F.sum(F.col("weight").cast("decimal(18,6)")), 4).cast("double").alias("global_weight"))


def cooccurrence(ec: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: chunks that hold both. A chunk has at most top_n
    entities, so its pairs are bounded and are made from its own array."""
    sets = ec.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher's ratio, or 0 where an upper bound is below the limit.
    The matcher keeps what it learns of its second sequence."""
    m, held, out = difflib.SequenceMatcher(None, autojunk=True), None, []
    for x, y in zip(a, b, strict=True):
        if y != held:
            m.set_seq2(y)
            held = y
        m.set_seq1(x)
        out.append(m.ratio() if m.quick_ratio() >= params.FUZZY_RATIO else 0.0)
    return pd.Series(out)


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s, l): names of ``short`` (s) inside names of ``long`` (l), without case. Names
    meet by a piece of ``GRAM`` letters: the short name's rarest among the long
    ones', which any name that holds it has; shorter names are looked up whole among
    all pieces of their length. Both are joins on equality, then a check."""
    s = short.select("s", F.lower("s").alias("low_s"))
    l = long.select("l", F.lower("l").alias("low_l")).filter(F.length("low_l") > 0)

    def grams(c, n):
        return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))

    pieces = F.array_distinct(F.flatten(F.array(*[grams(F.col("low_l"), n) for n in range(1, GRAM + 1)])))
    held = storage.written(l.select("l", "low_l", F.explode(pieces).alias("piece")), "pieces")
    uses = held.filter(F.length("piece") == GRAM).groupBy("piece").agg(F.count("*").alias("uses"))
    own = s.filter(F.length("low_s") > 0).select("s", "low_s", F.explode(F.when(F.length("low_s") >= GRAM, grams(F.col("low_s"), GRAM)).otherwise(F.array("low_s"))).alias("piece"))
    # a piece that no long name has rules the name out; else the rarest stands for it
    ranked = own.join(uses, "piece", "left").withColumn("uses", F.when(F.length("low_s") >= GRAM, F.coalesce("uses", F.lit(0))).otherwise(1))
    rarest = ranked.groupBy("s", "low_s").agg(F.min(F.struct("uses", "piece")).alias("r")).filter("r.uses > 0").select("s", "low_s", F.col("r.piece").alias("piece"))
    return held.join(session.small(rarest), "piece").filter(F.contains("low_l", "low_s")).select("s", "l").distinct()


def map_entities(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, entity, node, level): equality; for those without, containment
    either way without case; for those still without, the best alike one. Each
    level compares distinct names that are left; containment is a join on pieces
    of names, likeness one on lengths and letters, then an exact check."""
    names = storage.written(nodes.select(F.col("entity").alias("node")).distinct(), "names")
    asked = storage.written(asked.select("query_id", "entity").distinct(), "asked")
    exact = asked.join(names, asked["entity"] == names["node"]).select("query_id", "entity", "node", F.lit("exact").alias("level"))
    left = storage.written(asked.join(exact.select("query_id", "entity"), ["query_id", "entity"], "left_anti"), "left")
    open_ = left.select("entity").distinct()
    inside = contained(open_.select(F.col("entity").alias("s")), names.select(F.col("node").alias("l"))).select(F.col("s").alias("entity"), F.col("l").alias("node"))
    around = contained(names.select(F.col("node").alias("s")), open_.select(F.col("entity").alias("l"))).select(F.col("l").alias("entity"), F.col("s").alias("node"))
    within = storage.written(inside.unionByName(around).distinct(), "within")
    last = open_.join(within.select("entity").distinct(), "entity", "left_anti").filter(F.length("entity") >= params.FUZZY_LENGTH)
    best = alike(last, names)
    level = lambda df, name: left.join(df, "entity").select("query_id", "entity", "node", F.lit(name).alias("level"))
    return storage.written(exact.unionByName(level(within, "substr")).unionByName(level(best, "fuzzy")), "mapped")


def least_matched(both):
    """Letters that two names of so many in all must match for ``FUZZY_RATIO``."""
    return F.ceil(F.round(both * params.FUZZY_RATIO / 2, 6)).cast("int")


def _shared(a, b):
    """Neighbouring pairs that alike names of these lengths have in common at least."""
    return 3 * least_matched(a + b) - a - b - 1


def _pair_places(low):
    return F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.struct(F.substring(low, i, 2).alias("pair"), i.cast("int").alias("place")))


def _rarest_first(rows: DataFrame, uses: DataFrame, *names: str) -> DataFrame:
    """rows with ``pairs``, an array of (uses, pair, place) by rarity; a pair that
    no node has comes first."""
    each = rows.select(*names, F.explode(_pair_places(F.col(names[-1]))).alias("p")).select(*names, "p.*")
    ranked = each.join(session.small(uses), "pair", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return ranked.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("uses", "pair", "place"))).alias("pairs"))


def pair_uses(held: DataFrame) -> DataFrame:
    """(pair, uses): nodes that have each neighbouring pair."""
    return held.select(F.explode(F.array_distinct(F.transform(_pair_places(F.col("low_node")), lambda p: p["pair"]))).alias("pair")).groupBy("pair").agg(F.count("*").alias("uses"))


def fuzzy_index(held: DataFrame) -> DataFrame:
    """(pair, length, place, node, low_node): each node's rarest pairs, as many as
    the shortest partner that can be alike calls for."""
    b = F.length("low_node")
    shortest = F.ceil(F.round(params.FUZZY_RATIO * b / (2 - params.FUZZY_RATIO), 6)).cast("int")
    longest = F.floor(F.round((2 - params.FUZZY_RATIO) * b / params.FUZZY_RATIO, 6)).cast("int")
    least = F.array_min(F.transform(F.sequence(shortest, longest), lambda a: _shared(a, b)))
    rows = _rarest_first(held, pair_uses(held), "node", "low_node")
    return rows.select("node", "low_node", b.alias("length"), F.explode(F.slice("pairs", F.lit(1), F.greatest(b - least, F.lit(1)))).alias("p")).select("p.pair", "length", "p.place", "node", "low_node")


def fuzzy_probes(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(pair, length, place, entity, low): where a node alike each name would be found."""
    a, b = F.length("low"), F.col("length")
    shortest = F.ceil(F.round(params.FUZZY_RATIO * a / (2 - params.FUZZY_RATIO), 6)).cast("int")
    longest = F.floor(F.round((2 - params.FUZZY_RATIO) * a / params.FUZZY_RATIO, 6)).cast("int")
    rows = _rarest_first(wanted, pair_uses(held), "entity", "low").withColumn("length", F.explode(F.sequence(shortest, longest)))
    first = F.slice("pairs", F.lit(1), F.greatest(a - _shared(a, b), F.lit(1)))
    rows = rows.select("entity", "low", "length", F.explode(F.filter(first, lambda p: p["uses"] > 0)).alias("p"))
    least = least_matched(a + b)
    places = F.sequence(F.greatest(F.col("p.place") - (a - least), F.lit(1)), F.least(F.col("p.place") + (b - least), b - 1))
    return rows.filter(F.greatest(F.col("p.place") - (a - least), F.lit(1)) <= F.least(F.col("p.place") + (b - least), b - 1)).select("p.pair", "length", F.explode(places).alias("place"), "entity", "low")


def alike(last: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, node): the most alike node of each entity, of a ratio of at least
    ``FUZZY_RATIO``, the first by name of several. A prefix-filtered
    join proposes candidates, an exact ratio decides.

    The ratio is twice the matched letters m over both lengths a and b, so m is at
    least ``least_matched``. Matched letters lie in blocks, of which there are no more
    than letters unmatched and one, so the names share t = 3m - a - b - 1 or more
    neighbouring pairs, in the same order and moved by no more places than letters
    are unmatched. With pairs ordered by how many names have them, the rarest shared
    one is among the first (length - t) of either name: only these are indexed and
    looked up, under the pair, the node's length and its place."""
    wanted = last.select("entity", F.lower("entity").alias("low")).filter(F.length("low") >= 2)
    held = names.filter(F.length("node") >= params.FUZZY_LENGTH).select("node", F.lower("node").alias("low_node")).filter(F.length("low_node") >= 2)
    met = fuzzy_index(held).join(session.small(fuzzy_probes(wanted, held)), ["pair", "length", "place"]).select("entity", "low", "node", "low_node").distinct()
    rows = met.repartition("low_node").withColumn("ratio", _ratio("low", "low_node")).filter(F.col("ratio") >= params.FUZZY_RATIO)
    return rows.groupBy("entity").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "node"))["node"].alias("node"))


def route_multi_entity(mapped: DataFrame, least: int = 2) -> DataFrame:
    """Queries of which at least two entities map to nodes."""
    return mapped.groupBy("query_id").agg(F.countDistinct("entity").alias("n_entities")).filter(F.col("n_entities") >= least)


def khop(seeds: DataFrame, edges: DataFrame, hops: int = params.GRAPH_HOP) -> DataFrame:
    """(query_id, entity, hop): the least hops from any seed (query_id, entity)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = seeds.select("query_id", "entity").distinct().withColumn("hop", F.lit(0))
    if hops > 1:  # each hop reads the one before it from its table, not by its plan
        both, reached = storage.written(both, "khop-edges"), storage.written(reached, "khop")
    front = reached
    for h in range(1, hops + 1):
        front = front.join(both, front["entity"] == both["a"]).select("query_id", F.col("b").alias("entity")).distinct().join(reached.select("query_id", "entity"), ["query_id", "entity"], "left_anti").withColumn("hop", F.lit(h))
        if h < hops:
            front = storage.written(front, "khop")
        reached = reached.unionByName(front)
    return reached


#: Queries whose marks are one number.
MARKS = 64
#: Rows of marks that are unpacked at once inside a task.
UNPACKED = 1024


@dataclass
class Marked:
    """Entities that queries reach: queries (query_id, block, place), marks (entity, block,
    hop, mark), a query being the bit at its place in the numbers of its block."""

    queries: DataFrame
    marks: DataFrame


_MARK = "shiftleft(1L, place)"


def _numbered(rows: DataFrame) -> DataFrame:
    """(query_id, block, place) of the rows' queries."""
    number = F.row_number().over(W.orderBy("query_id")) - 1  # a set of queries
    names = rows.select("query_id").distinct().select("query_id", number.alias("n"))
    return storage.written(names.select("query_id", F.floor(F.col("n") / MARKS).cast("int").alias("block"), (F.col("n") % MARKS).alias("place")), "graph-queries")


def marked(hops: DataFrame) -> Marked:
    """(query_id, entity, hop) with the queries as bits."""
    hops = storage.written(hops, "graph-hops")
    names = _numbered(hops)
    return Marked(names, hops.join(session.small(names), "query_id").groupBy("entity", "block", "hop").agg(F.expr(f"bit_or({_MARK})").alias("mark")))


def reached(seeds: DataFrame, ec: DataFrame, hops: int = params.GRAPH_HOP) -> Marked:
    """``khop`` over the entities that share a chunk, with the queries as bits from the
    start: a chunk has the bits of all its entities, an entity those of all its chunks.
    Neither pairs of entities nor rows of (query, entity) are made."""
    seeds = storage.written(seeds.select("query_id", "entity").distinct(), "graph-seeds")
    names, held = _numbered(seeds), ec.filter("entity is not null").select("chunk_id", "entity").distinct()
    front = storage.written(seeds.join(session.small(names), "query_id").groupBy("entity", "block").agg(F.expr(f"bit_or({_MARK})").alias("mark")), "graph-marks")
    marks, seen = front.withColumn("hop", F.lit(0)), front
    for h in range(1, hops + 1):
        chunks = held.join(session.small(front), "entity").groupBy("chunk_id", "block").agg(F.bit_or("mark").alias("mark"))
        near = held.join(chunks, "chunk_id").groupBy("entity", "block").agg(F.bit_or("mark").alias("mark"))
        near = near.join(seen.withColumnRenamed("mark", "seen"), ["entity", "block"], "left").select("entity", "block", F.expr("mark & ~coalesce(seen, 0L)").alias("mark"))
        front = storage.written(near.filter("mark <> 0"), "graph-marks")
        marks = marks.unionByName(front.withColumn("hop", F.lit(h)))
        if h < hops:
            seen = seen.unionByName(front).groupBy("entity", "block").agg(F.bit_or("mark").alias("mark"))
    return Marked(names, marks)


def graph_sums(hops: DataFrame | Marked, ec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, block, sums), each query's sum of weights over 1 + hop at its place in
    its block of ``MARKS`` queries, null where it reaches none of the chunk's entities;
    and (query_id, block, place, top), top being the query's highest sum. Most queries
    reach most entities, so an entity meets its chunks with the queries as bits of a
    number, not once for each of them, and a chunk's entities are added up in one row."""
    hops = hops if isinstance(hops, Marked) else marked(hops)
    names, marks = hops.queries, hops.marks
    rows = ec.join(marks, "entity").groupBy("chunk_id", "block").agg(F.collect_list(F.struct((F.col("weight") / (1 + F.col("hop"))).alias("value"), "mark")).alias("e"))  # a chunk's own entities
    schema = rows.select("chunk_id", "block", F.array(F.lit(None).cast("double")).alias("sums")).schema

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, UNPACKED):
                b = whole.slice(start, UNPACKED)
                ends, values = b["e"].offsets.to_numpy(), b["e"].values
                value, mark = (values.field(c).to_numpy()[ends[0] : ends[-1]] for c in (0, 1))
                bits = np.unpackbits(np.ascontiguousarray(mark).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                first = ends[:-1] - ends[0]  # no list is empty
                sums, reached = np.add.reduceat(value[:, None] * bits, first), np.maximum.reduceat(bits, first)
                flat = pa.array(sums.ravel(), mask=reached.ravel() == 0)
                yield pa.RecordBatch.from_arrays([b["chunk_id"], b["block"], pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * MARKS, flat)], ["chunk_id", "block", "sums"])

    sums = storage.written(rows.mapInArrow(run, schema), "graph-sums")
    tops = sums.select("block", F.posexplode("sums").alias("place", "sum")).groupBy("block", "place").agg(F.max("sum").alias("top"))
    return sums, storage.written(names.join(tops, ["block", "place"]).filter("top > 0"), "graph-tops")


def score_graph_chunks(hops: DataFrame | Marked, ec: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): weights over 1 + hop, over the query's highest."""
    sums, tops = graph_sums(hops, ec)
    each = sums.select("chunk_id", "block", F.posexplode("sums").alias("place", "sum")).filter("sum is not null")
    return each.join(session.small(tops), ["block", "place"]).select("query_id", "chunk_id", F.round(F.col("sum") / F.col("top"), 6).alias("score"))


def best_graph_chunks(hops: DataFrame | Marked, ec: DataFrame, k: int = params.GRAPH_TOP_K) -> DataFrame:
    """The ranking of ``score_graph_chunks``; tasks hand on k rows a query."""
    sums, tops = graph_sums(hops, ec)
    held = tops.select("query_id", "block", "place", "top").toArrow().combine_chunks()  # a set of queries
    block, place, top = (held[c].to_numpy() for c in ("block", "place", "top"))
    names = held["query_id"].combine_chunks()
    schema = tops.select("query_id").limit(0).join(sums.select("chunk_id", F.lit(0.0).alias("score")).limit(0)).schema

    def run(batches):
        for b in (p for whole in batches for p in vector.blocks_of(whole)):
            b = b.take(pa.compute.sort_indices(b["chunk_id"]))  # by id, for ties
            of, all_ = b["block"].to_numpy(), b["sums"].flatten().to_numpy(zero_copy_only=False).reshape(-1, MARKS)
            for x in np.unique(of):
                own, at = np.flatnonzero(block == x), np.flatnonzero(of == x)
                if len(own):
                    scores = all_[at][:, place[own]].T / top[own][:, None]
                    query, row = vector.best(np.where(np.isnan(scores), -np.inf, vector.rounded(scores)), k)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(own[query])), b["chunk_id"].take(pa.array(at[row])), pa.array(scores[query, row])], ["query_id", "chunk_id", "score"])

    return ranking.top_k(sums.mapInArrow(run, schema).withColumn("score", F.round("score", 6)), k, "graph")


def search(queries: DataFrame, ec: DataFrame, asked: DataFrame, k: int = params.GRAPH_TOP_K, hops: int = params.GRAPH_HOP) -> DataFrame:
    mapped = map_entities(asked, ec.select("entity").distinct())
    seeds = mapped.join(route_multi_entity(mapped), "query_id", "left_semi").select("query_id", F.col("node").alias("entity"))
    return best_graph_chunks(reached(seeds, ec, hops), ec, k)
