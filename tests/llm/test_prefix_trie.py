"""The prefix trie against a plain one, its sort against sorted(), and odd rows."""

import hashlib
import random
import zlib

import pytest

from orrery.llm import prefix_trie as t

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie by definition. rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    nodes = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            node = nodes.setdefault(seq[:d], {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(seq):
                node["ends"].append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + ((len(nodes[p]["members"]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(nodes[p]["ends"])))
        out.append((min(nodes[p]["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(nodes[p]["members"]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], SCHEMA + ", turns int, path binary").repartition(5)
    got = t.trie(t.rebuilt(t.sequences(df)), **how)
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(seed, n, words=2, longest=9):
    rng = random.Random(seed)
    return [(c, k, rng.choice(["user", "assistant"]), rng.choice(["", "é", "long " * 30][:words])) for c in range(n) for k in range(rng.randrange(1, longest))]


def test_runs_merge_in_order_and_share_what_they_share():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 40):
        paths = [b"".join(bytes([rng.randrange(3)]) * t.KEY for _ in range(rng.randrange(7))) for _ in range(k * 9)]
        heads = t.Heads([t.front_coded([(p, (i,)) for i, p in enumerate(paths[r::k])]) for r in range(k)])
        got = list(t.merged(heads))
        assert [p for _, p, _ in got] == sorted(paths)
        assert all(n == t.shared(a[1], p) for a, (n, p, _) in zip(got, got[1:], strict=False))


def test_shared_turns_are_not_compared_again():
    rng = random.Random(6)
    base = bytes(t.KEY) * 500
    paths = [base + rng.randbytes(t.KEY) for _ in range(256)]
    heads = t.Heads([t.front_coded([(p, ()) for p in paths[r::16]]) for r in range(16)])
    assert len(list(t.merged(heads))) == 256
    assert heads.compared < 16 * 501 + 256 * 5  # each run's first head once, then the turn that differs


@pytest.mark.parametrize("how", [{}, {"range_bytes": 500, "run_rows": 3, "fan": 2}, {"range_bytes": 100, "run_rows": 2, "fan": 3}])
def test_the_same_trie_however_it_is_cut(spark, how):
    rows = conversations(1, 150) + [(c, k, "user", "same") for c in range(200, 420) for k in range(3)]
    rows += [(1000, k, "user", f"{k}") for k in range(300)] + [(1001, k, "user", f"{k}") for k in range(299)]
    assert built(spark, rows, **how) == plain(rows)


def test_rows_of_every_kind(spark):
    rows = [(5, None, None, None), (5, 1, None, "a"), (5, 0, "r", None), (6, 3, "r", "x" * 100_000), (7, 1, "ab", "c"), (8, 1, "a", "bc"), (None, 1, "r", "lost"), (2, 0, "u", "base absent"), (-4, 1, "u", "neg"), (10**12, 0, "u", "far"), (11, 2, "u", "x"), (11, -2, "u", "y")]
    assert built(spark, rows) == plain(rows)


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(9, 0, "u", "a"), (9, 0, "u", "a"), (9, 1, "u", "b")]
    assert built(spark, rows) == plain(rows)


def test_without_conversations_there_is_no_node(spark):
    assert built(spark, [(None, 0, "u", "a")]) == []


def test_ends_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK", 10)
    rows = [(c, k, "user", "same") for c in range(0, 500, 3) for k in range(9)]
    assert built(spark, rows) == plain(rows)
