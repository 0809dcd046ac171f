"""Exact dedup: the filter, the index under insertion and deletion, and odd rows."""

import hashlib
import random

import numpy as np
import pytest

from orrery.llm import dedup


def _digests(n, start=0):
    return dedup._matrix([hashlib.sha256(str(i).encode()).digest() for i in range(start, start + n)])


def test_a_filter_loses_nothing_and_frees_what_is_deleted():
    f, keys = dedup.Cuckoo.sized(5000), _digests(5000)
    assert f.insert(keys) and f.held == 5000 and f.contains(keys).all()
    others = _digests(20_000, 10_000)
    assert f.contains(others).mean() < 0.001
    f.delete(keys[:2500])
    assert f.held == 2500 and f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def test_a_full_filter_says_so_and_a_shard_grows():
    assert not dedup.Cuckoo(4).insert(_digests(17))
    s = dedup.Shard({}, None)
    before = s.filter.buckets
    for i in range(0, 3000, 100):
        s.add({k.tobytes(): [1, (True, i, i)] for k in _digests(100, i)})
    assert s.filter.buckets > before and s.filter.contains(_digests(3000)).all() and s.filter.held == 3000


def test_equal_fingerprints_of_other_keys_are_told_apart():
    s = dedup.Shard({}, None)
    a, b = bytes(16) + bytes(range(16)), b"\1" * 16 + bytes(range(16))  # same fingerprint and bucket
    s.add({a: [1, (True, 1, 0)]})
    s.add({b: [1, (True, 2, 1)]})
    assert s.stored == {a: [1, (True, 1, 0)], b: [1, (True, 2, 1)]} and s.filter.held == 2
    s.drop({a: [0, None]})
    assert s.filter.contains(dedup._matrix([b])).all() and list(s.stored) == [b]


def brute(rows):
    """rows: (doc_id, text) with null ids first."""
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda d: (d is not None, d or 0))
        out += [(d, ids[-1], len(ids), k == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()) for k, d in enumerate(ids)]
    return sorted(out, key=str)


def got(index):
    return sorted((tuple(r) for r in dedup.resolved(index).collect()), key=str)


@pytest.fixture
def rows():
    rng = random.Random(1)
    texts = [None, "", " ", "a", "A", "a ", "é", "é", "x" * 300_000, "hot"]
    many = [(i, rng.choice(texts + ["hot"] * 5)) for i in range(700)]
    return many + [(3, "a"), (3, "a"), (None, "only"), (None, "a"), (None, None), (-5, "neg")]


def test_rows_of_every_kind(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, row long, digest string").repartition(7)
    index = dedup.insert(dedup.empty(spark), docs)
    assert got(index) == brute(rows)


def test_an_empty_table(spark):
    index = dedup.insert(dedup.empty(spark), spark.createDataFrame([], "doc_id long, text string"))
    assert got(index) == []
    assert got(dedup.delete(index, spark.createDataFrame([(1,)], "doc_id long"))) == []


def test_batches_of_insertions_and_deletions_give_what_one_build_gives(spark, rows, monkeypatch):
    monkeypatch.setattr(dedup, "SHARD_KEYS", 1)
    monkeypatch.setattr(dedup, "LEAST_SHARDS", 2)
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index = dedup.insert(dedup.empty(spark), frame(rows[:100]))
    held, shards = rows[:100], index.shards
    for a, b, gone in ((100, 400, range(50, 90)), (400, 706, [3, None, -5, 99999]), (0, 50, range(0, 700, 2))):
        index = dedup.insert(index, frame(rows[a:b]))
        held = held + rows[a:b]
        index = dedup.delete(index, spark.createDataFrame([(g,) for g in gone], "doc_id long"))
        held = [r for r in held if r[0] not in set(gone)]
        assert got(index) == brute(held)
        live = sum(len(set(dedup.Cuckoo(r.buckets, r.slots).table.ravel()) - {0}) > 0 for r in index.state.filter("slots IS NOT NULL").collect())
        assert live and sum(dedup.Cuckoo(r.buckets, r.slots).held for r in index.state.filter("slots IS NOT NULL").collect()) == len({t or "" for _, t in held})
    assert index.shards > shards or shards >= 64
