"""A stored index under additions and deletions gives what one whole build gives."""

import pytest
from pyspark.sql import functions as F

from orrery import registry
from orrery.operators import kg
from orrery.plans import search, segments


def rankings(queries, index):
    out = {}
    for name, r in search.routes(queries, index).items():
        out[name] = sorted((x.query_id, x.rank, x.chunk_id, x.score) for x in r.collect())
    return out


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, source string, content string")


def triples_of(chunks):
    one = F.struct(F.concat(F.lit("Doc"), (F.col("chunk_id") % 7).cast("string"), F.lit("x")).alias("subject"), F.lit("near").alias("relation"), F.element_at(F.split("content", " "), 1).alias("object"))
    return chunks.select("chunk_id", F.col("source").alias("source_doc"), F.array(one).alias("triples"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.chunk_id, r.source, r.content) for r in registry.chunks(spark, sf).select("chunk_id", "source", "content").collect()]


def test_three_batches_of_adds_and_deletes(spark, sf, docs, tmp_path):
    queries = registry.asked(spark, sf)
    store = segments.Store(spark, str(tmp_path))
    live = {}

    def add(rows):
        df = chunks_of(spark, rows)
        store.add(df, triples_of(df))
        live.update((r[0], r) for r in rows)

    def delete(ids):
        store.delete(spark.createDataFrame([(i,) for i in ids], "chunk_id long"))
        for i in ids:
            live.pop(i, None)

    def whole():
        df = chunks_of(spark, list(live.values()))
        return search.build_index(df, graph=True, triples=kg.clean_triples(triples_of(df)))

    add(docs[:80])
    delete([3, 4, 5, 99999])
    add(docs[80:150] + [(7, "new", "replaced " + docs[12][2]), (8, "none", None)])
    delete([7, 81, 82] + list(range(20, 40)))
    add(docs[150:] + [docs[3], docs[25]])
    want = rankings(queries, whole())
    assert rankings(queries, store.index(graph=True)) == want and all(want.values())
    assert len(store.manifest().segments) == 3 and len(store.manifest().tombs) == 3
    store.compact(2)
    assert len(store.manifest().segments) == 2
    assert rankings(queries, store.index(graph=True)) == want
    delete([9, 160])
    want = rankings(queries, whole())
    assert rankings(queries, store.index(graph=True)) == want
    store.compact(1)
    store.vacuum()
    again = segments.Store(spark, str(tmp_path))
    assert len(again.manifest().segments) == 1 and again.manifest().tombs == []
    assert rankings(queries, again.index(graph=True)) == want


def test_a_lost_change_leaves_nothing_and_of_two_writers_one_fails(spark, docs, tmp_path, monkeypatch):
    store = segments.Store(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.index()
    first = store.add(chunks_of(spark, docs[:5]))
    stale = store.manifest()
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.add(chunks_of(spark, docs[5:9]))
    monkeypatch.undo()
    assert store.manifest() == first and store.index().chunks.count() == 5
    store.delete(spark.createDataFrame([(docs[0][0],)], "chunk_id long"))
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(stale, stale.last + 1, [], [])
    assert store.index().chunks.count() == 4


def test_odd_chunks(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path))
    store.add(chunks_of(spark, [(1, "s", "b"), (1, "s", "a"), (None, "s", "lost"), (2, None, "")]))
    assert sorted((r.chunk_id, r.content) for r in store.index().chunks.collect()) == [(1, "a"), (2, "")]
    before = store.manifest()
    assert store.delete(spark.createDataFrame([(77,)], "chunk_id long")) == before
    store.add(chunks_of(spark, []))
    assert store.index().words.stats.first().n == 1
