"""The index of inverted cells against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import registry
from orrery.operators import ivf, vector


def recall(spark, queries, vectors, index, k=20):
    got = ivf.search(queries, index, k)
    true = vector.search(queries, vectors, k).select("query_id", "chunk_id")
    return got.join(true, ["query_id", "chunk_id"], "left_semi").count() / true.count(), got


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf, size, tmp_path):
    queries, vectors = registry._vectors(spark, sf.replace("sf0.001", size))
    index = ivf.build(vectors, str(tmp_path / "ivf"))
    share, got = recall(spark, queries, vectors, index)
    assert share >= 0.9
    n = queries.count()
    assert got.count() == n * 20 and got.groupBy("query_id").agg(F.max("rank").alias("r")).filter("r <> 20").isEmpty()
    again = ivf.attach(spark, str(tmp_path / "ivf"))
    assert (again.probes, again.depth) == (index.probes, index.depth) and np.array_equal(again.codewords, index.codewords)


def test_clustered_vectors_read_few_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16)) * 3
    rows = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)) * 0.3
    rows[:1300] = rows[0]  # one vector on a third of all rows
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "chunk_id long, vec array<double>").repartition(4)
    index = ivf.build(vectors, str(tmp_path / "ivf"))
    queries = vectors.filter("chunk_id % 100 = 7").withColumnRenamed("chunk_id", "query_id")
    true = vector.search(queries, vectors, 20)
    got = ivf.search(queries, index, 20)
    score = lambda df: [r.score for r in df.orderBy("query_id", "rank").collect()]
    assert np.mean(np.isclose(score(got), score(true), atol=1e-6)) >= 0.9
    assert index.probes <= len(index.centroids) // 4
    few = ivf.search(queries.limit(1), index, 20)
    plan = few._jdf.queryExecution().toString()
    read = {r["table"]: (r.probed_bytes, r.all_bytes) for r in ivf.bytes_read(queries.limit(1), index).collect()}
    assert all(a < b / 2 for a, b in read.values())
    block = ivf._block(queries.limit(1), index, 20)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in block or "cell#" in block.split("PartitionFilters:")[1][:80], plan


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0] * 8), (2, [0.0] * 8), (3, None), (4, [-1.0] * 8), (4, [-1.0] * 8)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vec array<double>")
    index = ivf.build(vectors, str(tmp_path / "ivf"))
    got = ivf.search(spark.createDataFrame([(9, [2.0] * 8), (10, None)], "query_id long, vec array<double>"), index, 3)
    assert sorted((r.rank, r.chunk_id, r.score) for r in got.collect()) == [(1, 1, 1.0), (2, 4, -1.0), (3, 4, -1.0)]
