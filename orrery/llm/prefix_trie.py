"""The trie of conversation prefixes, from one sorted stream.

A conversation is a sequence of turns, a turn a key of 20 bytes: 16 of the SHA-256
of role and text, then the text's length in bytes. Texts are hashed where they are;
only keys travel. Equal sequences are folded with their number of members, then
ranges of sequences are sorted by an LCP-aware external mergesort: a task cuts its
range into sorted runs, each sequence front-coded, that is kept with the number of
turns it shares with the one before it and the turns after these. A loser tree
merges the runs; of two heads the one that shares more with the last output comes
first without a look at either, and where both share as much they are compared from
there on, so that no shared turn is compared twice. The merged stream drives a stack
of open nodes: what lies deeper than the shared turns is finished and leaves.

A range can't tell whether nodes on the paths of its first and its last sequence go
on in its neighbours. It hands these on as open paths, each node with what it has
gathered so far; the open paths of ``FAN`` adjacent ranges are one more stream for
the same stack, and so on until one is left. Rows and levels grow with the number of
ranges, never with a node's members: a first turn shared by a third of all
conversations is spread over a third of the ranges.

A conversation is one row of 20 bytes a turn; runs hold a range, about ``RANGE_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY = 20
#: Bytes of keys that a range is meant to have, and the fewest ranges.
RANGE_BYTES, LEAST_RANGES = 16 << 20, 16
#: Sequences of a sorted run.
RUN_ROWS = 4096
#: Open paths of so many ranges are joined by one task.
FAN = 64
#: Member ids that one chunk may span.
CHUNK = 1 << 16
#: The contract's rebuilding: conversations of a group, and most turns taken over.
GROUP, SHARED = 5, 9
NO_ENDS = hashlib.sha256(b"").digest()


# ---- sorting: front-coded runs and their loser tree

Item = tuple[int, bytes, tuple]


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two sequences have in common at their start; the first ``start`` are known to be."""
    most, i = min(len(a), len(b)) // KEY, start
    while i < most and a[i * KEY : (i + 1) * KEY] == b[i * KEY : (i + 1) * KEY]:
        i += 1
    return i


def front_coded(rows: list[tuple[bytes, tuple]]) -> list[Item]:
    """A sorted run: turns shared with the one before, the turns after these, the payload."""
    out, before = [], b""
    for path, load in sorted(rows, key=lambda r: r[0]):
        n = shared(before, path)
        out.append((n, path[n * KEY :], load))
        before = path
    return out


class Heads:
    """The heads of sorted runs. A head knows the turns it shares with the last output."""

    def __init__(self, runs: list[Iterable[Item]]):
        self.runs = [iter(r) for r in runs]
        self.path: list[bytes | None] = [b""] * len(runs)
        self.lcp, self.load = [0] * len(runs), [()] * len(runs)
        self.compared = 0  # turns looked at
        for r in range(len(runs)):
            self.advance(r)

    def advance(self, r: int) -> None:
        got = next(self.runs[r], None)
        if got is None:
            self.path[r] = None
        else:
            n, rest, load = got
            self.path[r], self.lcp[r], self.load[r] = self.path[r][: n * KEY] + rest, n, load

    def first(self, a: int, b: int) -> bool:
        """Whether a comes before b; the loser then knows what it shares with the winner."""
        x, y = self.path[a], self.path[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        if self.lcp[a] != self.lcp[b]:
            return self.lcp[a] > self.lcp[b]
        n = shared(x, y, self.lcp[a])
        self.compared += n - self.lcp[a] + 1
        before = (x[n * KEY :][:KEY], a) < (y[n * KEY :][:KEY], b)
        self.lcp[b if before else a] = n
        return before


def merged(heads: Heads) -> Iterator[tuple[int, bytes, tuple]]:
    """All sequences in order: turns shared with the one before, the whole path, the payload."""
    k = len(heads.runs)
    if not k:
        return
    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        a, b = (a, b) if heads.first(a, b) else (b, a)
        losers[node] = b
        return a

    winner = play(1) if k > 1 else 0
    while heads.path[winner] is not None:
        yield heads.lcp[winner], heads.path[winner], heads.load[winner]
        heads.advance(winner)
        node = (winner + k) // 2
        while node:
            if not heads.first(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


# ---- nodes: a stack of open paths

#: A node's sums so far: members, smallest of them, children, childless nodes below, bytes saved, hash of the ends here.
EMPTY = (0, None, 0, 0, 0, None)


def _less(a, b):
    return b if a is None else a if b is None else min(a, b)


def _plus(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], _less(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4], a[5] or b[5]


class Open:
    """The open path of a stream of (shared turns, path, sums by depth from a depth on).

    ``emit(depth, nid, parent's nid, sums)`` takes each finished node. Nodes on the
    first path may have begun before the stream and are handed on by ``rest``, as
    are those of the last path, which may go on after it."""

    def __init__(self, emit, whole: bool = False):
        self.emit, self.sums, self.nids = emit, [], []
        self.path = self.first = b""
        self.left: list[tuple] = []  # sums of first-path nodes that ended here, deepest first
        self.edge = -1 if whole else None  # depth to which the first path is still open on its left

    def take(self, n: int, path: bytes, start: int, sums: list[tuple]) -> None:
        if self.edge is None:
            self.first, self.edge = path, len(path) // KEY
        else:
            self.close(n + 1)
        for d in range(len(self.sums), len(path) // KEY + 1):
            key = path[(d - 1) * KEY : d * KEY] if d else b""
            self.nids.append(hashlib.blake2b((self.nids[-1] if d else b"") + key, digest_size=16).digest())
            self.sums.append(EMPTY)
        self.path = path
        for d, s in enumerate(sums, start):
            self.sums[d] = _plus(self.sums[d], s)

    def close(self, least: int) -> None:
        """Ends the nodes of this depth and deeper."""
        while len(self.sums) > least:
            d = len(self.sums) - 1
            s = self.sums.pop()
            nid = self.nids.pop()
            if d <= self.edge:
                self.left.append(s)
                self.edge = d - 1
                continue
            size = int.from_bytes(self.path[d * KEY - 4 : d * KEY], "big") if d else 0
            s = (s[0], s[1], s[2], s[3] or 1, s[4] + (s[0] - 1) * size, s[5])
            self.emit(d, nid, self.nids[-1] if d else None, s)
            if d:
                self.sums[-1] = _plus(self.sums[-1], (s[0], s[1], 1, s[3], s[4], None))

    def rest(self) -> list[tuple[int, bytes, int, list[tuple]]]:
        """The stream's open paths, as a stream of one or two."""
        if self.edge is None:
            return []
        common_ = self.sums[: self.edge + 1]
        out = [(0, self.first, 0, common_ + self.left[::-1])]
        if self.path != self.first:
            out.append((self.edge, self.path, self.edge + 1, self.sums[self.edge + 1 :]))
        return out


def _members(c: int, smallest: int, ends: bytes) -> tuple:
    return c, smallest, 0, 0, 0, ends


# ---- Spark

_SUMS = "array<struct<n: bigint, least: bigint, children: bigint, leaves: bigint, saved: decimal(38,0), ends: binary>>"
_NODES = f"depth int, nid binary, parent binary, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary, range int, pos int, lcp int, path binary, start int, sums {_SUMS}"
_ARROW = pa.schema([("depth", pa.int32()), ("nid", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.binary()), ("range", pa.int32()), ("pos", pa.int32()), ("lcp", pa.int32()), ("path", pa.binary()), ("start", pa.int32()), ("sums", pa.list_(pa.struct([("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.decimal128(38, 0)), ("ends", pa.binary())])))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


def _walked(stream: Iterable[tuple[int, bytes, int, list[tuple]]], at: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Finished nodes of a stream, then its open paths (none if it is the whole)."""
    from decimal import Decimal

    out: list[dict] = []
    path = Open(lambda d, nid, parent, s: out.append({"depth": d, "nid": nid, "parent": parent, "conv_id": s[1], "n_convs": s[0], "n_children": s[2], "n_leaves": s[3], "saved_tokens": s[4], "ends": s[5] or NO_ENDS}), whole)
    for item in stream:
        path.take(*item)
        if len(out) >= 20_000:
            yield _batch(out)
            out.clear()
    if whole:
        path.close(0)
    else:
        for pos, (n, keys, start, sums) in enumerate(path.rest()):
            out.append({"range": at, "pos": pos, "lcp": n, "path": keys, "start": start, "sums": [{"n": s[0], "least": s[1], "children": s[2], "leaves": s[3], "saved": Decimal(s[4]), "ends": s[5]} for s in sums]})
    if out:
        yield _batch(out)


def _range(run_rows: int):
    """One range of sequences, in any order: sorted runs, their merge, its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs, held = [], []
        for b in batches:
            for path, n, least, ends in zip(*(b[c].to_pylist() for c in ("path", "n", "least", "ends")), strict=True):
                held.append((path, (n, least, ends)))
                if len(held) >= run_rows:
                    runs.append(front_coded(held))
                    held = []
        if held:
            runs.append(front_coded(held))
        stream = ((n, path, len(path) // KEY, [_members(*load)]) for n, path, load in merged(Heads(runs)))
        yield from _walked(stream, TaskContext.get().partitionId(), False)

    return run


def _joined(fan: int, whole: bool):
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        rows = sorted(parts.to_pylist(), key=lambda r: (r["range"], r["pos"]))

        def stream():
            before = b""
            for r in rows:
                n = r["lcp"] if r["pos"] else shared(before, r["path"])
                yield n, r["path"], r["start"], [(s["n"], s["least"], s["children"], s["leaves"], int(s["saved"]), s["ends"]) for s in r["sums"]]
                before = r["path"]

        return pa.Table.from_batches(list(_walked(stream(), rows[0]["range"] // fan, whole)), _ARROW)

    return run


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns) with each conversation's keys in the order of its turns, null
    first; turns of the same number by key. Null role or text count as empty; rows
    without a conversation are none's. Texts are hashed whole, however long."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(part(role)).cast("string"), F.lit(":"), part(role), part(text)).cast("binary"), 256)
    key = F.unhex(F.concat(digest.substr(1, 2 * (KEY - 4)), F.lpad(F.hex(F.octet_length(part(text))), 8, "0")))
    rows = df.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), key.alias("key")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t"), _by_turn), lambda t: t.key).alias("turns"))


def _by_turn(a, b):
    """Null turns first, then by turn, then by key."""
    less, more = F.lit(-1), F.lit(1)
    by_key = F.when(a.key < b.key, less).when(a.key > b.key, more).otherwise(F.lit(0))
    return F.when(a.turn.isNull() & b.turn.isNull(), by_key).when(a.turn.isNull(), less).when(b.turn.isNull(), more).when(a.turn < b.turn, less).when(a.turn > b.turn, more).otherwise(by_key)


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, path): the first h turns of the group's first conversation, then the
    own turns after the first h; h = crc32 of the decimal id, modulo ``SHARED``."""
    base = convs.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("taken"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int"))
    of = lambda c: F.coalesce(F.col(c), F.array().cast("array<binary>"))
    own_rest = F.when(F.size("turns") > F.col("h"), F.expr("slice(turns, h + 1, size(turns))")).otherwise(F.array().cast("array<binary>"))
    return own.join(base, "base", "left").select("conv_id", F.concat(F.slice(of("taken"), F.lit(1), F.col("h")), own_rest).alias("turns"))


def _streamed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a group's ids in order, hashed one after the other."""
    schema = pa.schema([("sid", pa.binary()), ("ends", pa.binary())])
    sid, digest = None, None
    for b in batches:
        done = []
        for s, ids in zip(b["sid"].to_pylist(), b["ids"].to_pylist(), strict=True):
            if s == sid:
                digest.update(b"," + ids.encode())
            else:
                if sid is not None:
                    done.append((sid, digest.digest()))
                sid, digest = s, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*done, strict=True)], schema=schema)
    if sid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sid], pa.binary()), pa.array([digest.digest()], pa.binary())], schema=schema)


def folded(seqs: DataFrame) -> DataFrame:
    """(path, n, least, ends) of each distinct sequence: its members' number, the
    smallest, and the SHA-256 of all in order. A group's ids are joined in chunks of
    an id range, which tasks make apart; one task then only hashes the chunks, as
    SHA-256 asks for, and holds one at a time."""
    seqs = common.written(seqs.select("conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t)), "").alias("path")).select("conv_id", F.unhex("path").alias("path")).withColumn("sid", F.unhex(F.substring(F.sha2("path", 256), 1, 40))), "trie-sequences")
    groups = common.written(seqs.groupBy("sid").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.min("path").alias("path")), "trie-groups")
    one = groups.filter("n = 1").withColumn("ends", F.unhex(F.sha2(F.col("least").cast("string").cast("binary"), 256)))
    many = groups.filter("n > 1")
    ids = common.spread(seqs.select("sid", "conv_id"), many.select("sid", "n"), "sid", "n", seqs.count())
    chunks = ids.groupBy("sid", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    hashed = chunks.repartition("sid").sortWithinPartitions("sid", "chunk").select("sid", "ids").mapInArrow(common.trimmed(_streamed_ends), "sid binary, ends binary")
    return one.unionByName(many.join(hashed, "sid")).select("path", "n", "least", "ends")


def trie(seqs: DataFrame, range_bytes: int = RANGE_BYTES, run_rows: int = RUN_ROWS, fan: int = FAN) -> DataFrame:
    """A row for each node of the trie of (conv_id, turns): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (see
    ``op13_prefix_trie``).

    A node that no conversation ends in has the empty string's hash. Without a
    conversation there is no node, not even the root. Members that repeat an id
    count each time."""
    rows = common.written(folded(seqs), "trie-folded")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("path") + 64), F.lit(0)).alias("held")).first()
    parts = max(LEAST_RANGES, -(-total.held // range_bytes))
    found = common.written(rows.repartitionByRange(parts, "path").mapInArrow(common.trimmed(_range(run_rows)), _NODES), "trie-nodes-0")
    levels, level = [found], 0
    while True:
        last = found.filter("range IS NOT NULL").agg(F.max("range")).first()[0]
        if last is None:
            break
        level += 1
        found = common.written(found.filter("range IS NOT NULL").groupBy(F.floor(F.col("range") / fan).cast("int").alias("group")).applyInArrow(_joined(fan, last < fan), _NODES), f"trie-nodes-{level}")
        levels.append(found)
    nodes = levels[0].filter("range IS NULL")
    for more in levels[1:]:
        nodes = nodes.unionByName(more.filter("range IS NULL"))
    parents = nodes.filter("n_children > 0").select(F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of"))
    below = common.spread(nodes.filter("depth > 0"), parents, "parent", "of", nodes.count())
    every = below.drop("of").unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return every.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt ``conversations``."""
    convs = common.written(sequences(common.table(spark, sf_dir, "conversations")), "trie-conversations")
    return trie(rebuilt(convs))
