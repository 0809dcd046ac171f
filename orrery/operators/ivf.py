"""Approximate dense retrieval from a stored index of inverted cells.

Vectors (scaled to unit length, so that their product is the cosine) are dealt to
the cell of their nearest of about sqrt(n) centroids. Two tables lie in folders by
cell: short codes, and the vectors. A code has a byte for each of ``parts`` slices of
the residual, the number of its nearest codeword. A search reads the codes of the
nearest cells alone, adds up products looked up per query, and scores the best
``depth`` candidates exactly from these cells' vectors.

How many cells to probe and how deep to score is measured when the index is made,
on a hundred or so stored vectors against exact search, for a target recall. The
coarse centroids come from k-means on a sample of ``TRAIN_PER_CELL`` rows a cell,
the codewords from a sample of ``TRAIN_CODES`` residuals, one task for each slice;
every row is indexed. A cell's rows are spread over as many files as it needs, so
one with a third of all rows is read by many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params, session, storage
from . import ranking, vector

MOST_CELLS = 4096
TRAIN_PER_CELL, TRAIN_CODES, CODEWORDS = 64, 1 << 16, 256
#: Stored vectors by which probes and depth are chosen, and the recall asked of them.
TRIALS, TARGET = 128, 0.95
#: Queries whose tables are sent to the tasks at once: BLOCK x parts x CODEWORDS floats.
BLOCK = 2048
#: Rows of a cell that go to one file.
FILE_ROWS = 1 << 18
ROUNDS = 12


@dataclass
class Index:
    """A stored index: tables by cell under ``path``, centroids (cells x dims),
    codewords (parts x CODEWORDS x dims / parts), and the measured settings."""

    path: str
    centroids: np.ndarray
    codewords: np.ndarray
    probes: int
    depth: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), -1)


def lloyd(rows: np.ndarray, k: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centres of a bounded sample; a centre that loses its rows is put on the
    row farthest from its own centre."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = ((rows - centres[near]) ** 2).sum(1).argsort()[::-1][: len(empty)]
            centres[empty[: len(far)]] = rows[far]
    return np.concatenate([centres, np.zeros((k - len(centres), rows.shape[1]))])


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1) - 2 * rows @ centroids.T).argmin(1)


def _coarse(vectors: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Centroids by Spark's k-means over a sample of bounded size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(cells * TRAIN_PER_CELL)
    rows = storage.written(rows.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features")), "ivf-sample")
    model = KMeans(k=cells, seed=seed, maxIter=ROUNDS).fit(rows)
    found = np.array(model.clusterCenters())
    return np.concatenate([found, found[:1].repeat(cells - len(found), 0)]) if len(found) < cells else found


def _codewords(assigned: DataFrame, centroids: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Codewords of every slice of the residuals, each trained by a task of its own."""
    sample = assigned.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(TRAIN_CODES)
    width = centroids.shape[1] // parts

    def sliced(batches):
        for b in batches:
            rest = _matrix(b["vec"]) - centroids[b["cell"].to_numpy()]
            for p in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), p, np.int32)), pa.array([r.tobytes() for r in rest[:, p * width : (p + 1) * width]], pa.binary())], ["part", "rest"])

    def trained(key: tuple, rows: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(sorted(rows["rest"].to_pylist()))).reshape(-1, width)
        return pa.table({"part": pa.array([rows["part"][0].as_py()], pa.int32()), "words": pa.array([lloyd(values, CODEWORDS, seed).tobytes()], pa.binary())})

    got = storage.written(sample, "ivf-residuals").mapInArrow(sliced, "part int, rest binary").groupBy("part").applyInArrow(trained, "part int, words binary").collect()
    return np.stack([np.frombuffer(r.words).reshape(CODEWORDS, width) for r in sorted(got, key=lambda r: r.part)])


def build(vectors: DataFrame, path: str, cells: int | None = None, parts: int = 8, k: int = params.VECTOR_TOP_K, target: float = TARGET, seed: int = 11) -> Index:
    """Indexes (chunk_id, vec) at ``path``, a new folder. Vectors have one length, a
    multiple of ``parts``; null vectors are left out, zero ones are never found."""
    spark = vectors.sparkSession
    rows = vectors.filter("vec IS NOT NULL").select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))

    def scaled(batches):
        for b in batches:
            if b.num_rows:
                v = unit(_matrix(b["vec"]))
                yield pa.RecordBatch.from_arrays([b["chunk_id"], pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))], ["chunk_id", "vec"])

    rows = storage.written(rows.mapInArrow(scaled, rows.schema), "ivf-unit")
    n = rows.count()
    if not n:
        raise ValueError("no vectors")
    cells = cells or max(1, min(MOST_CELLS, round(math.sqrt(n))))
    centroids = _coarse(rows, cells, seed)

    def dealt(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest(_matrix(b["vec"]), centroids).astype(np.int32))], ["chunk_id", "vec", "cell"])

    schema = rows.withColumn("cell", F.lit(0)).schema
    assigned = storage.written(rows.mapInArrow(dealt, schema), "ivf-cells")
    words = _codewords(assigned, centroids, parts, seed)
    width = centroids.shape[1] // parts

    def coded(batches):
        for b in batches:
            rest = _matrix(b["vec"]) - centroids[b["cell"].to_numpy()]
            codes = np.stack([nearest(rest[:, p * width : (p + 1) * width], words[p]).astype(np.uint8) for p in range(parts)], 1)
            yield pa.RecordBatch.from_arrays([b["chunk_id"], pa.array([c.tobytes() for c in codes], pa.binary()), b["cell"]], ["chunk_id", "code", "cell"])

    sizes = assigned.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))  # a row a cell
    spread = assigned.join(F.broadcast(sizes), "cell").withColumn("file", F.pmod(F.xxhash64("chunk_id"), "files"))
    spread.repartition("cell", "file").drop("file", "files").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    stored.select("chunk_id", "vec", "cell").mapInArrow(coded, stored.select("chunk_id", F.lit(b"").alias("code"), "cell").schema).write.partitionBy("cell").parquet(f"{path}/codes")
    index = Index(path, centroids, words, cells, n)
    index.probes, index.depth = _measured(rows, index, k, target)
    meta = [(centroids.tobytes(), words.tobytes(), cells, parts, index.probes, index.depth)]
    spark.createDataFrame(meta, "centroids binary, codewords binary, cells int, parts int, probes int, depth int").write.parquet(f"{path}/settings")
    return index


def attach(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/settings").first()
    c = np.frombuffer(bytes(r.centroids)).reshape(r.cells, -1)
    return Index(path, c, np.frombuffer(bytes(r.codewords)).reshape(r.parts, CODEWORDS, -1), r.probes, r.depth)


def _measured(rows: DataFrame, index: Index, k: int, target: float) -> tuple[int, int]:
    """The fewest cells that hold the share of true neighbours asked for, half of
    what may be lost being left to the codes; then the depth that reaches the target."""
    trials = storage.written(rows.orderBy(F.xxhash64("chunk_id", F.lit(3)), "chunk_id").limit(TRIALS).select(F.col("chunk_id").alias("query_id"), "vec"), "ivf-trials")
    true = storage.written(vector.search(trials, rows, k).select("query_id", "chunk_id"), "ivf-true")
    cell_of = index.table(rows.sparkSession, "codes").select("chunk_id", "cell").join(F.broadcast(true), "chunk_id").select("query_id", "cell").collect()  # TRIALS x k rows
    q = {r.query_id: unit(np.array([r.vec], float))[0] for r in trials.collect()}
    place = {i: {int(c): n for n, c in enumerate(_order(v[None], index.centroids)[0])} for i, v in q.items()}
    far = np.sort([place[r.query_id][r.cell] for r in cell_of])
    probes = int(far[max(0, math.ceil((1 + target) / 2 * len(far)) - 1)]) + 1 if len(far) else 1
    index.probes, depth, n = probes, 4 * k, rows.count()
    want = true.count()
    while True:
        index.depth = depth
        hit = search(trials, index, k, fill=False).join(true, ["query_id", "chunk_id"], "left_semi").count()
        if hit >= target * want or depth >= n:
            if hit < target * want and index.probes < len(index.centroids):
                index.probes = min(len(index.centroids), index.probes + max(1, index.probes // 4))
                continue
            return index.probes, min(depth, n)
        depth *= 2


def _order(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argsort((centroids * centroids).sum(1) - 2 * q @ centroids.T, axis=1, kind="stable")


def _pruned(df: DataFrame, cells: list[int]) -> DataFrame:
    """Only the folders of these cells are listed and read."""
    return df.filter(F.col("cell").isin([int(c) for c in cells]))


def search(queries: DataFrame, index: Index, k: int = params.VECTOR_TOP_K, fill: bool = True) -> DataFrame:
    """Top k of (query_id, vec), approximately. Queries are taken in blocks; a block's
    tables are of bounded size and go to the tasks that read codes. Queries whose
    cells hold fewer than k vectors are searched exactly."""
    spark, out = queries.sparkSession, None
    q = queries.filter("vec IS NOT NULL").select("query_id", F.col("vec").cast("array<double>").alias("vec"))
    n = q.count()
    blocks = max(1, -(-n // BLOCK))
    q = storage.written(q.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "ivf-queries")
    for b in range(blocks):
        part = _block(q.filter(F.col("__block") == b).drop("__block"), index, k)
        out = part if out is None else out.unionByName(part)
    if not fill:
        return out
    out = storage.written(out, "ivf-found")
    full = out.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    rest = storage.written(q.drop("__block").join(full, "query_id", "left_anti"), "ivf-rest")
    if rest.isEmpty():
        return out
    return out.join(full, "query_id", "left_semi").unionByName(vector.search(rest, index.table(spark, "vectors"), k))


def kept(batches, tables: np.ndarray, base: np.ndarray, by_cell: dict[int, np.ndarray], depth: int):
    """(q, chunk_id, cell, score): of each piece of the codes the ``depth`` best of
    every query that probes their cells, whichever cells these are."""
    slices = np.arange(tables.shape[1])
    for b in (p for whole in batches for p in vector.blocks_of(whole)):
        cells, ids = b["cell"].to_numpy(), b["chunk_id"]
        codes = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
        held = [(int(c), np.flatnonzero(cells == c)) for c in np.unique(cells)]
        for start in range(0, len(tables), vector.COLUMNS):
            part = tables[start : start + vector.COLUMNS]
            got = np.full((len(part), b.num_rows), -np.inf, np.float32)
            for c, at in held:
                who = by_cell.get(c, np.zeros(0, np.int64))
                who = who[(who >= start) & (who < start + len(part))]
                if len(who):
                    got[np.ix_(who - start, at)] = base[who, c][:, None] + part[who - start][:, slices, codes[at]].sum(2)
            query, row = vector.best(got, depth)
            yield pa.RecordBatch.from_arrays([pa.array((query + start).astype(np.int32)), ids.take(pa.array(row)), pa.array(cells[row].astype(np.int32)), pa.array(got[query, row].astype(np.float64))], ["q", "chunk_id", "cell", "score"])


def _block(q: DataFrame, index: Index, k: int) -> DataFrame:
    spark = q.sparkSession
    held = q.collect()  # about BLOCK queries
    v = unit(np.array([r.vec for r in held], float).reshape(len(held), -1))
    if not held:
        v = np.zeros((0, index.centroids.shape[1]))
    probed = _order(v, index.centroids)[:, : index.probes]
    parts, _, width = index.codewords.shape
    tables = np.stack([v[:, p * width : (p + 1) * width] @ index.codewords[p].T for p in range(parts)], 1).astype(np.float32)  # query, part, codeword
    by_cell: dict[int, np.ndarray] = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}
    sent = spark.sparkContext.broadcast((tables, (v @ index.centroids.T).astype(np.float32), by_cell))
    depth = index.depth

    def scored(batches):
        return kept(batches, *sent.value, depth)

    codes = _pruned(index.table(spark, "codes"), list(by_cell)).select("chunk_id", "code", "cell")
    schema = codes.select(F.lit(0).alias("q"), "chunk_id", F.col("cell").cast("int").alias("cell"), F.lit(0.0).alias("score")).schema
    order = ranking.W.partitionBy("q").orderBy(F.desc("score"), "chunk_id")
    near = codes.mapInArrow(scored, schema).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= depth)
    asked = spark.createDataFrame([(i, r.query_id, [float(x) for x in r.vec]) for i, r in enumerate(held)], q.select(F.lit(0).alias("q"), "query_id", F.col("vec").alias("query_vec")).schema)
    near = storage.written(near.select("q", "chunk_id", "cell"), "ivf-near")  # counted, then joined
    near = near.join(F.broadcast(asked), "q")  # about BLOCK rows
    vectors = _pruned(index.table(spark, "vectors"), list(by_cell)).withColumn("cell", F.col("cell").cast("int"))
    sim = F.try_divide(vector.dot(F.col("query_vec"), F.col("vec")), vector.norm(F.col("query_vec")) * vector.norm(F.col("vec")))
    exact = vectors.join(session.small(near), ["cell", "chunk_id"]).select("query_id", "chunk_id", F.round(sim, 6).alias("score"))
    return ranking.top_k(exact.filter("score IS NOT NULL"), k, "vector")


def bytes_read(queries: DataFrame, index: Index) -> DataFrame:
    """(table, probed_bytes, all_bytes): what a search of these queries reads of each table."""
    spark = queries.sparkSession
    v = unit(np.array([r.vec for r in queries.select("vec").collect()], float))
    cells = sorted({int(c) for c in _order(v, index.centroids)[:, : index.probes].ravel()})
    rows = []
    for name in ("codes", "vectors"):
        size = F.sum("size").alias("n")
        files = index.table(spark, name).select("_metadata.file_path", F.col("_metadata.file_size").alias("size"), "cell").distinct()
        rows.append((name, files.filter(F.col("cell").isin(cells)).agg(size).first().n or 0, files.agg(size).first().n or 0))
    return spark.createDataFrame(rows, "table string, probed_bytes long, all_bytes long")
