"""Exact dedup by an index of live digests, kept in cuckoo filters.

The digest space is dealt out to shards. A shard holds a cuckoo filter (four
slots of 16-bit fingerprints a bucket) and, in the bucketed table behind it, the
full 256-bit keys. A digest that the filter doesn't hold is new without a look at
the table; a hit is verified against the shard's stored keys, so a false alarm
costs a look and never merges two texts. A filter that overflows is rebuilt, twice
as large, from the stored keys; a shard that outgrows ``SHARD_KEYS`` is halved by
one more bit of the digest. Deletion takes one copy of a fingerprint out as soon as
the last live row of its text goes.

Every change writes a new generation of the index in the shared folder and reads
the one before it, so a lost executor costs a task and a failed change nothing.
Texts are hashed where they are and never moved. A task folds the digests of its
own rows before the shuffle, so that a text with a third of all rows reaches its
shard as a row for each task, and goes back to its rows by a broadcast whose size
is bounded (``common.spread``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Slots a bucket, and the share of slots filled at which a filter is made larger.
SLOTS, FULL = 4, 0.9
#: Rounds of eviction after which an insertion counts as overflow.
ROUNDS = 64
#: Keys that a shard is meant to hold, and the fewest shards.
SHARD_KEYS, LEAST_SHARDS = 1 << 16, 64
#: Digests that a task folds before it hands them on.
FOLDED = 1 << 16


class Cuckoo:
    """A cuckoo filter over 32-byte digests; insertion and deletion in bulk."""

    def __init__(self, buckets: int, table: bytes | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * FULL) + 1)))))

    @property
    def held(self) -> int:
        return int(np.count_nonzero(self.table))

    def _marks(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never zero) and first bucket of each; digests: n x 32 bytes."""
        words = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), 4)
        finger = (words[:, 3] & np.uint64(0xFFFF)).astype(np.uint16)
        return np.where(finger == 0, np.uint16(1), finger), (words[:, 2] & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, finger: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint, from either of its two."""
        return bucket ^ ((finger.astype(np.int64) * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def contains(self, digests: np.ndarray) -> np.ndarray:
        finger, bucket = self._marks(digests)
        at = lambda b: (self.table[b] == finger[:, None]).any(1)
        return at(bucket) | at(self._other(bucket, finger))

    def insert(self, digests: np.ndarray) -> bool:
        """False on overflow; the table then holds part of them and must be rebuilt."""
        finger, bucket = self._marks(digests)
        rng = np.random.default_rng(len(digests))
        for turn in range(ROUNDS):
            if not len(finger):
                return True
            order = np.argsort(bucket, kind="stable")
            finger, bucket = finger[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rank = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.r_[starts, len(bucket)]))
            free = self.table[bucket] == 0
            room = free.sum(1)
            fits = rank < room
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(rank)), np.minimum(rank, SLOTS - 1)]
            self.table[bucket[fits], slot[fits]] = finger[fits]
            thrown = ~fits & (rank == room) & (turn > 0)  # the first left over of a bucket evicts
            at, into = bucket[thrown], rng.integers(0, SLOTS, int(thrown.sum()))
            victims = self.table[at, into]
            self.table[at, into] = finger[thrown]
            finger = np.r_[victims, finger[~fits & ~thrown]]
            bucket = np.r_[at, bucket[~fits & ~thrown]]
            bucket = self._other(bucket, finger)
        return not len(finger)

    def delete(self, digests: np.ndarray) -> None:
        """Takes one copy of each digest's fingerprint out; only digests held may be given."""
        finger, bucket = self._marks(digests)
        for f, a, b in zip(finger, bucket, self._other(bucket, finger), strict=True):
            for at in (a, b):
                where = np.flatnonzero(self.table[at] == f)
                if len(where):
                    self.table[at, where[0]] = 0
                    break


def _matrix(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), 32)


class Shard:
    """The live digests of one shard: a filter, and behind it the stored keys with
    their number of live rows and the largest (id, row) of these."""

    def __init__(self, stored: dict[bytes, list], table: tuple[int, bytes] | None):
        self.stored = stored
        self.filter = Cuckoo(*table) if table else Cuckoo.sized(len(stored))
        if not table and stored:
            self.grow()

    def grow(self, times: int = 1) -> None:
        """A new filter from the stored keys; larger by so much, and until they fit."""
        keys, buckets = _matrix(list(self.stored)), times * self.filter.buckets
        while True:
            self.filter = Cuckoo(buckets)
            if self.filter.insert(keys):
                return
            buckets *= 2

    def add(self, got: dict[bytes, list]) -> None:
        """got: by digest, rows added and the largest (id, row) of these."""
        if not got:
            return
        keys = list(got)
        hits = self.filter.contains(_matrix(keys))
        new = [k for k, hit in zip(keys, hits.tolist(), strict=True) if not (hit and k in self.stored)]
        for k, hit in zip(keys, hits.tolist(), strict=True):
            if hit and (held := self.stored.get(k)):
                held[0] += got[k][0]
                held[1] = max(held[1], got[k][1])
        self.stored.update((k, list(got[k])) for k in new)
        if new and (len(self.stored) > FULL * SLOTS * self.filter.buckets or not self.filter.insert(_matrix(new))):
            self.grow(2)

    def drop(self, got: dict[bytes, list]) -> None:
        """got: by digest, rows left and the largest (id, row) of these, if any."""
        gone = []
        for k, (left, best) in got.items():
            if k in self.stored:
                if left:
                    self.stored[k] = [left, best]
                else:
                    del self.stored[k]
                    gone.append(k)
        if gone:
            self.filter.delete(_matrix(gone))


#: An id as a pair that orders null before all others.
_BEST = "struct<known: boolean, id: bigint, row: bigint>"
_CHANGE = f"shard bigint, digest binary, gone boolean, n bigint, best {_BEST}"
_STATE = f"shard bigint, digest binary, n bigint, best {_BEST}, buckets bigint, slots binary"


def _best(rows: list) -> list[tuple]:
    return [(r["known"], r["id"] or 0, r["row"]) if r else None for r in rows]


def _pairs(best: tuple | None) -> dict | None:
    return best and {"known": best[0], "id": best[1] if best[0] else None, "row": best[2]}


def _folded(shards: int):
    """Map side: digests of a task's rows, each once (or once every ``FOLDED``)."""

    def batch(held: dict) -> pa.RecordBatch:
        keys = list(held)
        shard = [int.from_bytes(k[:8], "big") & (shards - 1) for k in keys]
        cols = [pa.array(shard, pa.int64()), pa.array(keys, pa.binary()), pa.array([False] * len(keys)), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([_pairs(held[k][1]) for k in keys], _ARROW_BEST)]
        return pa.RecordBatch.from_arrays(cols, ["shard", "digest", "gone", "n", "best"])

    def run(batches):
        held: dict[bytes, list] = {}
        for b in batches:
            for digest, doc, row in zip(b["digest"].to_pylist(), b["doc_id"].to_pylist(), b["row"].to_pylist(), strict=True):
                best = (doc is not None, doc or 0, row)
                if got := held.get(digest):
                    got[0] += 1
                    got[1] = max(got[1], best)
                else:
                    held[digest] = [1, best]
            if len(held) >= FOLDED:
                yield batch(held)
                held = {}
        if held:
            yield batch(held)

    return run


_ARROW_BEST = pa.struct([("known", pa.bool_()), ("id", pa.int64()), ("row", pa.int64())])


def _changed(key: tuple, state: pa.Table, change: pa.Table) -> pa.Table:
    """The next state of one shard."""
    stored, table = {}, None
    for digest, n, best, buckets, slots in zip(*(state[c].to_pylist() for c in ("digest", "n", "best", "buckets", "slots")), strict=True):
        if slots is None:
            stored[digest] = [n, _best([best])[0]]
        else:
            table = (buckets, slots)
    shard = Shard(stored, table)
    adds: dict[bytes, list] = {}
    drops: dict[bytes, list] = {}
    for digest, gone, n, best in zip(change["digest"].to_pylist(), change["gone"].to_pylist(), change["n"].to_pylist(), _best(change["best"].to_pylist()), strict=True):
        if gone:
            drops[digest] = [n, best]
        elif digest not in adds:
            adds[digest] = [n, best]
        else:  # another task's rows of the same text: the filter is asked again
            shard.add(adds)
            adds = {digest: [n, best]}
    shard.add(adds)
    shard.drop(drops)
    keys, at = list(shard.stored), key[0].as_py() if hasattr(key[0], "as_py") else key[0]
    n = len(keys)
    cols = [
        pa.array([at] * (n + 1), pa.int64()),
        pa.array([*keys, None], pa.binary()),
        pa.array([*(shard.stored[k][0] for k in keys), None], pa.int64()),
        pa.array([*(_pairs(shard.stored[k][1]) for k in keys), None], _ARROW_BEST),
        pa.array([None] * n + [shard.filter.buckets], pa.int64()),
        pa.array([None] * n + [shard.filter.table.tobytes()], pa.binary()),
    ]
    return pa.Table.from_arrays(cols, ["shard", "digest", "n", "best", "buckets", "slots"])


@dataclass
class Index:
    """A generation of the index: ``state`` has a row for each live digest and one
    for each shard's filter; ``rows`` has (doc_id, row, digest) of all live rows."""

    state: DataFrame
    rows: DataFrame
    shards: int

    @property
    def keys(self) -> DataFrame:
        return self.state.filter("slots IS NULL").select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))


def _digested(docs: DataFrame, text: str, key: str, name: str) -> DataFrame:
    return common.written(docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest")), name)


def _next(state: DataFrame, change: DataFrame, name: str) -> DataFrame:
    return common.written(state.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(_changed, _STATE), name)


def _shards(rows: int) -> int:
    return 1 << max((LEAST_SHARDS - 1).bit_length(), int(np.ceil(np.log2(max(rows, 1) / SHARD_KEYS))))


def empty(spark: SparkSession) -> Index:
    rows = "doc_id bigint, row bigint, digest binary"
    return Index(spark.createDataFrame([], _STATE), spark.createDataFrame([], rows), LEAST_SHARDS)


def insert(index: Index, docs: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    """index with the rows of docs. A null text counts as empty, a null id comes
    before all others; rows may repeat, within docs and between calls; columns
    other than the two are not read, whatever their names. Texts are hashed whole,
    however long. An empty table changes nothing."""
    fresh = _digested(docs, text, key, "dedup-rows")
    first = index.rows.agg(F.max("row")).first()[0]
    if first is not None:
        fresh = fresh.withColumn("row", F.col("row") + first + 1)
    total = fresh.count() + (0 if first is None else index.rows.count())
    state, shards = index.state, max(index.shards, _shards(total))
    if shards > index.shards:  # one more bit of the digest; filters are made anew from the stored keys
        state = state.filter("slots IS NULL").withColumn("shard", F.conv(F.hex(F.substring("digest", 1, 8)).substr(9, 8), 16, 10).cast("long").bitwiseAND(F.lit(shards - 1)))
    change = fresh.mapInArrow(common.trimmed(_folded(shards)), _CHANGE)
    return Index(_next(state, change, "dedup-state"), fresh if first is None else index.rows.unionByName(fresh), shards)


def delete(index: Index, ids: DataFrame, key: str = "doc_id") -> Index:
    """index without the rows of these ids (ids it doesn't hold change nothing, a
    null id stands for rows without one). Where the row that stayed goes, the next
    largest takes its place; where the last goes, its digest leaves the filter."""
    gone = ids.select(F.col(key).cast("long").alias("doc_id")).distinct()
    same = F.expr("r.doc_id <=> g.doc_id")
    rows = common.written(index.rows.alias("r").join(gone.alias("g"), same, "left_anti"), "dedup-rows")
    hurt = common.written(index.rows.alias("r").join(gone.alias("g"), same, "left_semi").select("digest").distinct(), "dedup-hurt")
    best = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), "row")
    left = rows.join(hurt, "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("n"), F.max(best).alias("best"))
    shard = F.conv(F.hex(F.substring("digest", 1, 8)).substr(9, 8), 16, 10).cast("long").bitwiseAND(F.lit(index.shards - 1))
    change = hurt.join(left, "digest", "left").select(shard.alias("shard"), "digest", F.lit(True).alias("gone"), F.coalesce("n", F.lit(0)).alias("n"), "best")
    return Index(_next(index.state, change, "dedup-state"), rows, index.shards)


def resolved(index: Index) -> DataFrame:
    """A row for each live row: its id, that of the row of its text that stays (the
    largest; of rows that share it, one), how many rows have the text, whether it
    stays, and the text's SHA-256."""
    rows = common.spread(index.rows, index.keys, "digest", "group_size", index.rows.count())
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op11_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row of its text that stays."""
    return resolved(insert(empty(spark), common.table(spark, sf_dir, "documents")))
