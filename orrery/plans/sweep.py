"""Indexes of several chunkings side by side, built in one pass and searched at once.

Chunks and statistics carry their configuration; a query of a configuration
is a query of its own, with the struct (config, query_id) as its id, so that fusion,
reranking and measures are the ones used elsewhere.

All windows of all configurations are many times the texts, so they are never a table:
the texts' sentences are, and a task makes its windows anew for the words' statistics,
for the scores, and for the contents of what was found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params, storage
from ..functions import text as T
from ..functions.batches import pieces
from ..operators import bm25, chunking, ranking, rerank, vector


def sentences(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, s, n) of (source, text), and the code files, as tables. Texts are dealt
    out first: a table of one file would be one task's."""
    rows = files.filter(F.trim(F.coalesce("text", F.lit(""))) != "").repartition("source")
    code = F.lower(F.regexp_extract("source", r"(\.[^.]*)$", 1)) == ".py"
    return storage.written(chunking.cut(rows.filter(~code)), "sweep-sentences"), storage.written(rows.filter(code), "sweep-code")


def chunked(texts: DataFrame, code: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(config, chunk_id, source, content) of ``sentences`` under every (size,
    overlap); a chunk's id is that of ``process_documents`` under its config's number."""
    out = chunking.windows_of(texts, pairs)
    for size in sorted({s for s, _ in pairs}):  # code is cut by size alone
        own = chunking.ast_chunks(code, size).select("source", "chunk_index", "content")
        configs = F.array(*[F.lit(i) for i, (s, _) in enumerate(pairs) if s == size])
        out = out.unionByName(own.withColumn("config", F.explode(configs)))
    name = F.concat(F.col("config").cast("string"), F.lit("|"), T.chunk_id(F.col("source"), F.col("chunk_index")))
    return out.select("config", name.alias("chunk_id"), "source", "content")


def _under(found: DataFrame, config: int) -> DataFrame:
    return found.withColumn("query_id", F.struct(F.lit(config).alias("config"), "query_id"))


def _flat(words: pa.ListArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Each list's length, and all words one after another."""
    ends = words.offsets.to_numpy().astype(np.int64)
    return np.diff(ends), words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()


def _statistics(words: DataFrame, configs: int) -> tuple[dict[int, float], DataFrame]:
    """({config: avgdl}, (config, term, idf)) of (config, chunk_id, terms): a piece of a
    batch counts the chunks of each configuration that hold a word, and hands on a row a
    word with a count for each; chunks and tokens are rows of other kinds."""
    names = [f"n{i}" for i in range(configs)]

    def run(batches):
        for b in pieces(batches, 2):
            n, held = _flat(b.column(2))
            config, size = b.column(0).to_numpy().astype(np.int64), max(1, len(held.dictionary))
            row, term = np.divmod(np.unique(np.repeat(np.arange(b.num_rows), n) * size + held.indices.to_numpy()), size)  # a chunk's word once
            df = np.bincount(term * configs + config[row], minlength=len(held.dictionary) * configs).reshape(-1, configs)
            chunks, tokens = np.bincount(config[n > 0], minlength=configs), np.zeros(configs, np.int64)
            np.add.at(tokens, config, n)
            kind = np.concatenate([np.zeros(len(df), np.int32), [1, 2]]).astype(np.int32)
            words = pa.concat_arrays([held.dictionary, pa.array(["", ""], pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(kind), words, *[pa.array(np.concatenate([df[:, i], [chunks[i], tokens[i]]]).astype(np.int64)) for i in range(configs)]], ["kind", "term", *names])

    schema = "kind int, term string, " + ", ".join(f"{c} bigint" for c in names)
    counted = storage.written(words.mapInArrow(run, schema).groupBy("kind", "term").agg(*[F.sum(c).alias(c) for c in names]), "sweep-counted")
    held = {r.kind: r for r in counted.filter("kind > 0").collect()}  # two rows
    if not held:
        return {}, counted.select(F.lit(0).alias("config"), "term", F.lit(0.0).alias("idf")).limit(0)
    n, tokens = [held[1][c] for c in names], [held[2][c] for c in names]
    raw = [F.when(F.col(c) > 0, F.log(n[i] - F.col(c) + 0.5) - F.log(F.col(c) + 0.5)) for i, c in enumerate(names)]
    mean = counted.filter("kind = 0").agg(*[F.avg(x).alias(c) for x, c in zip(raw, names, strict=True)]).first()
    idf = [F.struct(F.lit(i).alias("config"), F.when(x < 0, params.BM25_EPSILON * F.lit(mean[i]).cast("double")).otherwise(x).alias("idf")) for i, x in enumerate(raw)]
    each = counted.filter("kind = 0").select("term", F.explode(F.array(*idf)).alias("x")).select("x.config", "term", "x.idf").filter("idf is not null")
    return {i: tokens[i] / n[i] for i in range(configs) if n[i]}, each


def _pruned(rows: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """Each query's k best of (query_id, chunk_id, score), by rounded score and id."""
    held = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    query = held["query_id"].dictionary_encode().indices.to_numpy()
    name = np.empty(len(query), np.int64)
    name[pa.compute.sort_indices(held["chunk_id"]).to_numpy()] = np.arange(len(query))
    order = np.lexsort((name, -vector.rounded(held["score"].to_numpy()), query))
    query = query[order]
    return held.take(pa.array(np.sort(order[np.arange(len(query)) - np.searchsorted(query, query) < k])))


def _scores(asked: pa.Table, vectors: pa.Table, avgdl: dict[int, float], k: int):
    """For mapInArrow over (config, chunk_id, terms): the task's k best chunks of every
    query, route and configuration. A chunk's words are in its row, so BM25 adds them up there."""
    terms = asked["term"].combine_chunks().dictionary_encode()
    config, place, weight = asked["config"].to_numpy(), terms.indices.to_numpy(), asked["weight"].to_numpy()
    ids = asked["query_id"].combine_chunks()
    each = {c: bm25._scored(ids.filter(pa.array(config == c)), place[config == c], weight[config == c], k) for c in np.unique(config).tolist()}
    near, most = vector._scored(vectors, k), 4 * k * max(1, len(vectors))

    def matched(b: pa.RecordBatch, mean: float) -> pa.RecordBatch:
        n, held = _flat(b.column(2))
        to = pa.compute.index_in(held.dictionary, value_set=terms.dictionary).fill_null(-1).to_numpy()[held.indices.to_numpy()]
        row = np.repeat(np.arange(b.num_rows), n)[to >= 0]
        one, tf = np.unique(row * max(1, len(terms.dictionary)) + to[to >= 0], return_counts=True)
        row, to = np.divmod(one, max(1, len(terms.dictionary)))
        gain = tf * (params.BM25_K1 + 1) / (tf + params.BM25_K1 * (1 - params.BM25_B + params.BM25_B * n[row] / mean))
        rows, first = np.unique(row, return_index=True)
        held = pa.StructArray.from_arrays([pa.array(to.astype(np.int32)), pa.array(gain)], ["place", "gain"])
        return pa.RecordBatch.from_arrays([b.column(1).take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), held)], ["chunk_id", "matched"])

    def run(batches):
        best: dict[tuple[str, int], list] = {}
        for b in pieces(batches, 2):
            of = b.column(0).to_numpy()
            for c in np.unique(of).tolist():
                own = b.filter(pa.array(of == c))
                found = {"vector": near([pa.RecordBatch.from_arrays([own.column(1), vector.hashed(own.column(2))], ["chunk_id", "vec"])])}
                if c in each and len(words := matched(own, avgdl[c])):
                    found["bm25"] = (x.filter(pa.compute.greater(x["score"], 0)) for x in each[c]([words]))
                for route, rows in found.items():
                    kept = best.setdefault((route, c), [])
                    kept += [x for x in rows if x.num_rows]
                    if sum(x.num_rows for x in kept) > most:
                        kept[:] = [_pruned(kept, k)]
        for (route, c), kept in best.items():
            if kept:
                x = _pruned(kept, k)
                yield pa.RecordBatch.from_arrays([pa.array([route] * x.num_rows), pa.array([c] * x.num_rows, pa.int32()), *x.columns], ["route", "config", "query_id", "chunk_id", "score"])

    return run


def search(files: DataFrame, queries: DataFrame, pairs: list[tuple[int, int]], scorer=None) -> tuple[DataFrame, DataFrame]:
    """(chunks found, reranked rows) of all configurations; a row's query_id is the struct
    (config, query_id), config being the pair's place in the list. Queries are taken in
    blocks, which are sent to the tasks."""
    windows = chunked(*sentences(files), pairs)
    words = windows.select("config", "chunk_id", T.tokenize(F.col("content")).alias("terms"))
    avgdl, idf = _statistics(words, len(pairs))
    blocks = max(1, -(-queries.count() // bm25.BLOCK))
    queries = storage.written(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "sweep-queries")
    parts = [_searched(windows, words, idf, avgdl, queries.filter(F.col("block") == b).drop("block"), pairs, scorer) for b in range(blocks)]
    return ranking.append_routes(*[c for c, _ in parts]).distinct(), ranking.append_routes(*[r for _, r in parts])


def _searched(windows: DataFrame, words: DataFrame, idf: DataFrame, avgdl: dict[int, float], queries: DataFrame, pairs: list[tuple[int, int]], scorer) -> tuple[DataFrame, DataFrame]:
    k = params.BM25_TOP_K
    asked = idf.join(F.broadcast(bm25.query_terms(queries)), "term").select("config", "query_id", "term", (F.col("times") * F.col("idf")).alias("weight")).toArrow()  # a block
    vecs = vector.embed(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("content")))
    vecs = vecs.select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec")).toArrow()
    schema = queries.select(F.lit("").alias("route"), F.lit(0).alias("config"), "query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score")).schema
    rows = storage.written(words.mapInArrow(_scores(asked, vecs, avgdl, k), schema).withColumn("score", F.round("score", 6)), "sweep-scores")
    own = lambda route, i: rows.filter((F.col("route") == route) & (F.col("config") == i)).select("query_id", "chunk_id", "score")
    found = [_under(ranking.top_k(own("bm25", i).filter("score > 0"), k, "bm25"), i) for i in range(len(pairs))]
    found += [_under(ranking.top_k(own("vector", i), k, "vector"), i) for i in range(len(pairs))]
    fused = storage.written(ranking.rrf(ranking.append_routes(*found)), "sweep-fused")
    ids = F.broadcast(fused.select("chunk_id").distinct())  # both routes' k of a block's queries
    kept = storage.written(windows.join(ids, "chunk_id", "left_semi").select(*windows.columns), "sweep-kept")
    configs = F.explode(F.array(*[F.lit(i) for i in range(len(pairs))]))
    asked = queries.select(configs.alias("config"), "query_id", "query").select(F.struct("config", "query_id").alias("query_id"), "query")
    return kept, rerank.rerank(fused, asked, kept, scorer=scorer)
