"""SimHash near-duplicates linked by a binary trie self-join.

A fingerprint has a bit set where more than half of the shingles' 64-bit hashes
have it set. Equal fingerprints are folded into one before any join, so copies
never multiply. Distinct fingerprints that differ in at most ``budget`` bits
agree on one of ``budget + 1`` bit ranges; each range's value names a group, and
inside a group a binary trie is joined with itself: pairs of nodes go down
together, their differing bits add up, and a pair is dropped as soon as the sum
exceeds the budget. A group returns the links of a spanning forest, never all
its pairs. Groups above ``group_rows`` are parted again by ranges of their
remaining bits, and where even those are large into chunks of which each pair
is joined by a task of its own, so no group is bounded by one task's memory.
Components come from minimum labels with pointer jumping, each round written to
the shared folder.

Defined results: null text is an empty one; very long texts are hashed whole where
they are, in memory that is a few times the text; a text of no words has the
fingerprint zero and is linked like any other; fewer words than a shingle give
one shingle of all of them; repeated ids are separate rows with one component;
a null id is a document of its own that takes part in links but is never chosen as
a component's id unless all members' ids are null; an empty table gives an empty
result; other columns don't matter to ``components`` and are kept by ``keep_first``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 64
WORDS = 3
BUDGET = 2
SEED = 42
GROUP_ROWS = 8192
LEAF = 32
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_STEP = 1 << 16
#: Wide fingerprints: shingles of five words, and bits that candidates may differ
#: in (a pair at 0.8 differs in 39 +- 6 of 256 bits, so 60 lets nearly all pass).
WIDE_WORDS, WIDE_BUDGET, SIMILARITY, RECALL = 5, 60, 0.8, 0.99
#: Random fingerprints in a bucket of a table.
BUCKET = 32
#: Bits that mark a set's members where candidates are many.
MARKS = 4096
#: Up to so many ids (16 MB) are broadcast; more are joined.
BROADCAST_IDS = 1 << 20
#: Copies of the unique side of a join whose other side may have a hot key.
SALT = 8
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_hashes(text: str | None, n_words: int = WORDS) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, repeats included; none without words."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n_words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    view, n = memoryview(joined), len(words) - n_words + 1
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[n_words - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _STEP):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprint(text: str | None, n_words: int = WORDS) -> int:
    return majority(shingle_hashes(text, n_words))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """256 bits: the majority of each of four hashes made from a shingle's."""
    out = []
    for k in _MIX:
        x = (h ^ (h >> np.uint64(32))) * k
        out.append(majority(x ^ (x >> np.uint64(29))))
    return np.array(out, ">u8").tobytes()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, whole, text): hashes of the text and of all columns, which
    tell rows apart that share an id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.xxhash64(*[F.col(c) for c in docs.columns]).alias("whole"), text.alias("text"))


def fingerprints(docs: DataFrame, n_words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, whole, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t, n_words) for t in batch.column(3).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got)], ["doc_id", "tie", "whole", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(common.trimmed(run), "doc_id long, tie long, whole long, fp long")


# --------------------------------------------------------------- trie join


def trie_pairs(a: np.ndarray, b: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sorted distinct fingerprints ``a`` and ``b`` (or of
    ``a`` with itself, each pair once) that differ in at most ``budget`` bits;
    a fingerprint is a uint64, or a row of several, sorted by the first first.

    A trie node is a range of the sorted array at a depth; all node pairs of a
    depth go down in one vectorised step. Pairs of few fingerprints are compared
    directly."""
    same = b is None
    a = a[:, None] if a.ndim == 1 else a
    b = a if same else b[:, None] if b.ndim == 1 else b
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    front = [np.array([v], np.int64) for v in (0, len(a), 0, len(b), 0)]
    left, right = [], []
    for depth in range(BITS * a.shape[1]):
        la, ha, lb, hb, err = front
        small = (ha - la) * (hb - lb) <= LEAF
        if small.any():
            for i, j in _leaves(a, b, [v[small] for v in front], budget):
                left.append(i)
                right.append(j)
            la, ha, lb, hb, err = front = [v[~small] for v in front]
        if not len(la):
            break
        bit, word = np.uint64(1) << np.uint64(BITS - 1 - depth % BITS), depth // BITS
        # first index of each node whose bit is set
        ma, mb = _middle(a[:, word], la, ha, bit), _middle(b[:, word], lb, hb, bit)
        kids = []
        for x0, x1, y0, y1, more in ((la, ma, lb, mb, 0), (ma, ha, mb, hb, 0), (la, ma, mb, hb, 1), (ma, ha, lb, mb, 1)):
            ok = (x0 < x1) & (y0 < y1) & (err + more <= budget)
            if same and more and x0 is ma:
                ok &= la != lb  # the mirror of the pair before
            kids.append([v[ok] for v in (x0, x1, y0, y1, err + more)])
        front = [np.concatenate(v) for v in zip(*kids, strict=True)]
    else:
        for i, j in _leaves(a, b, front, budget):
            left.append(i)
            right.append(j)
    i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    if same:
        i, j = np.minimum(i, j), np.maximum(i, j)
        ok = i < j
        i, j = i[ok], j[ok]
    return i, j


def _middle(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """The first index of each range whose fingerprint has the bit, all ranges searched at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        is_set = (x[np.minimum(mid, len(x) - 1)] & bit) != 0
        hi = np.where(open_ & is_set, mid, hi)
        lo = np.where(open_ & ~is_set, mid + 1, lo)


def _leaves(a, b, front, budget):
    la, ha, lb, hb, _ = front
    wide, tall = ha - la, hb - lb
    for at in range(0, len(la), _STEP):
        s = slice(at, at + _STEP)
        n = (wide * tall)[s]
        node = np.repeat(np.arange(len(n)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i, j = la[s][node] + k // tall[s][node], lb[s][node] + k % tall[s][node]
        far = np.bitwise_count(a[i, 0] ^ b[j, 0]).astype(np.int32)
        for w in range(1, a.shape[1]):
            far += np.bitwise_count(a[i, w] ^ b[j, w])
        ok = far <= budget
        yield i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    root = np.arange(n) if parent is None else parent
    while True:
        ri, rj = root[i], root[j]
        differ = ri != rj
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(ri, rj)[differ], np.minimum(ri, rj)[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _spans(budget: int, low: int, width: int) -> list[tuple[int, int]]:
    """``budget + 1`` adjacent (first bit, width) ranges of the given bits."""
    cuts = [low + width * k // (budget + 1) for k in range(budget + 2)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]


def _bits(fp, first: int, width: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _grouped(fps: DataFrame, budget: int, group_rows: int) -> DataFrame:
    """(fp, g, side): rows to be joined within g; side null: all with all, else
    0 with 1. Large groups are parted by their other bits, then into chunks."""
    spans = _spans(budget, 0, BITS)
    first = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _bits(F.col("fp"), *s).alias("v")) for k, s in enumerate(spans)])).alias("s")).select("fp", F.xxhash64("s.k", "s.v").alias("g"), F.col("s.k").alias("k"))
    large = first.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).drop("n")
    plain = first.join(large, "g", "left_anti").select("fp", "g", F.lit(None).cast("int").alias("side"))
    # the bits outside range k, as a number of their own
    subs = []
    for k, (x, w) in enumerate(spans):
        rest = F.col("fp").bitwiseAND(F.lit((1 << x) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), x + w) if x + w < BITS else F.lit(0).cast("long"), x))
        subs.append(F.when(F.col("k") == k, F.array(*[F.struct(F.lit(m).alias("m"), _bits(rest, *s).alias("v")) for m, s in enumerate(_spans(budget, 0, BITS - w))])))
    second = first.join(large, "g", "left_semi").withColumn("s", F.explode(F.coalesce(*subs))).select("fp", F.xxhash64("g", "s.m", "s.v").alias("g"))
    sizes = second.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).select("g", F.ceil(F.col("n") / group_rows).cast("int").alias("chunks"))
    part = second.join(sizes, "g", "left_anti").select("fp", "g", F.lit(None).cast("int").alias("side"))
    chunk = second.join(sizes, "g").withColumn("c", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    pairs = chunk.select("fp", "g", "c", other).select("fp", F.xxhash64("g", F.least("c", "o"), F.greatest("c", "o")).alias("g"), F.when(F.col("c") < F.col("o"), 0).when(F.col("c") > F.col("o"), 1).cast("int").alias("side"))
    return plain.unionByName(part).unionByName(pairs)


def _tree(i: np.ndarray, j: np.ndarray, far: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Indexes of pairs (i, j) that join the parts (``root``: each node's first
    of its part) in a spanning forest, the pairs of the least ``far`` first
    (Boruvka's rounds)."""
    rank = np.empty(len(i), np.int64)
    order = np.lexsort((j, i, far))
    rank[order] = np.arange(len(i))
    live, kept = np.arange(len(i)), []
    while True:
        live = live[root[i[live]] != root[j[live]]]
        if not len(live):
            return np.concatenate(kept) if kept else live
        best = np.full(len(root), len(i))
        np.minimum.at(best, root[i[live]], rank[live])
        np.minimum.at(best, root[j[live]], rank[live])
        own = order[np.unique(best[best < len(i)])]
        kept.append(own)
        root = forest(len(root), i[own], j[own], root)


class Rows:
    """Columns of rows to be joined: fp (words of 64 bits), id, g, side, and, where
    given, n (members of the set), part and bits (marks of the set's members)."""

    def __init__(self, **columns: np.ndarray):
        self.columns = columns
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.id)

    def take(self, at) -> Rows:
        return Rows(**{k: v[at] for k, v in self.columns.items()})

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        out = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if pa.types.is_binary(column.type):  # of one length
                ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
                out[name] = data.reshape(len(column), -1).view(">u8").astype(np.uint64)
            else:
                out[name] = column.fill_null(-1).to_numpy(zero_copy_only=False)
        return Rows(**out)

    @staticmethod
    def joined(rows: list[Rows]) -> Rows:
        return rows[0] if len(rows) == 1 else Rows(**{k: np.concatenate([r.columns[k] for r in rows]) for k in rows[0].columns})


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    far = np.zeros(len(x), np.int32)
    for w in range(x.shape[1]):
        far += np.bitwise_count(x[:, w] ^ y[:, w])
    return far


def _possible(rows: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs may be links by what the rows tell: other parts, sizes that a
    similarity of ``SIMILARITY`` allows, and marks: each mark of one set that the
    other lacks is a member that the other lacks. No link is ever ruled out."""
    ok = np.ones(len(i), bool)
    if "part" in rows.columns:
        ok &= rows.part[i] != rows.part[j]
    if "n" in rows.columns:
        a, b = rows.n[i], rows.n[j]
        both = np.minimum(a, b)
        if "bits" in rows.columns:
            x, y = rows.bits[i], rows.bits[j]
            both = np.minimum(a - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), b - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        ok &= both >= SIMILARITY * (a + b - both)
    return ok


def _pairs(rows: Rows, cuts: np.ndarray, budget: int):
    """(i, j, differing bits) of the pairs of each group that may be links, in
    pieces. Small groups are compared all at once, others go down the trie."""
    size = np.diff(cuts)
    small = (size <= LEAF) & (rows.side[cuts[:-1]] < 0)
    end = np.repeat(cuts[1:], size)
    more = np.where(np.repeat(small, size), end - 1 - np.arange(len(rows)), 0)  # partners behind each row
    upto = np.cumsum(more)
    for lo, hi in _pieces(upto, _STEP):
        i = np.repeat(np.arange(lo, hi), more[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[lo:hi] - more[lo:hi] - (upto[lo - 1] if lo else 0), more[lo:hi])
        far = _differ(rows.fp[i], rows.fp[j])
        ok = far <= budget
        i, j, far = i[ok], j[ok], far[ok]
        ok = _possible(rows, i, j)
        yield i[ok], j[ok], far[ok]
    for k in np.flatnonzero(~small & (size > 1)).tolist():
        at = np.arange(cuts[k], cuts[k + 1])
        if rows.side[at[0]] < 0:
            at = at[np.lexsort(rows.fp[at].T[::-1])]
            i, j = trie_pairs(rows.fp[at], None, budget)
            i, j = at[i], at[j]
        else:
            a, b = (at[rows.side[at] == v] for v in (0, 1))
            a, b = (v[np.lexsort(rows.fp[v].T[::-1])] for v in (a, b))
            i, j = trie_pairs(rows.fp[a], rows.fp[b], budget)
            i, j = a[i], b[j]
        for lo in range(0, len(i), _STEP):
            x, y = i[lo : lo + _STEP], j[lo : lo + _STEP]
            ok = _possible(rows, x, y)
            yield x[ok], y[ok], _differ(rows.fp[x[ok]], rows.fp[y[ok]])


def _pieces(upto: np.ndarray, most: int):
    """Ranges of rows whose counts, summed in ``upto``, are about ``most``."""
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _joined(rows: DataFrame, budget: int, how: str) -> DataFrame:
    """(a, b, far): links of (fp binary, id, g, side, ...) within each g. ``tie``:
    those that tie a component's members to its first; ``tree``: pairs within the
    budget that join the parts (or rows) in a spanning forest, the nearest first;
    ``all``: all such pairs. One task joins whole groups, which its sort has put
    side by side; memory is bounded by the largest group."""

    def found(x: Rows) -> pa.RecordBatch | None:
        cuts = np.concatenate([[0], np.flatnonzero(x.g[1:] != x.g[:-1]) + 1, [len(x)]])
        got = [p for p in _pairs(x, cuts, budget) if len(p[0])]
        if not got:
            return None
        i, j, far = (np.concatenate(v) for v in zip(*got, strict=True))
        if how == "tie":
            root = forest(len(x), i, j)
            j = np.flatnonzero(root != np.arange(len(root)))
            i, far = root[j], np.zeros(len(j), np.int32)
        elif how == "tree":
            root = np.arange(len(x))
            if "part" in x.columns:
                group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                order = np.lexsort((x.part, group))
                new = np.concatenate([[True], (x.part[order][1:] != x.part[order][:-1]) | (group[order][1:] != group[order][:-1])])
                first = np.minimum.reduceat(order, np.flatnonzero(new))
                root[order] = first[np.cumsum(new) - 1]
            keep = _tree(i, j, far, root)
            i, j, far = i[keep], j[keep], far[keep]
        return pa.RecordBatch.from_arrays([pa.array(x.id[i]), pa.array(x.id[j]), pa.array(far.astype(np.int32))], ["a", "b", "far"])

    def run(batches):
        held: list[Rows] = []  # the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Rows.of(batch)
            if held and x.g[-1] == held[0].g[0]:
                held.append(x)
                continue
            cut = int(np.searchsorted(x.g != x.g[-1], False, side="left")) if x.g[0] == x.g[-1] else int(np.flatnonzero(x.g != x.g[-1])[-1]) + 1
            out = found(Rows.joined([*held, x.take(slice(0, cut))])) if held or cut else None
            held = [x.take(slice(cut, None))]
            if out is not None:
                yield out
        out = found(Rows.joined(held)) if held else None
        if out is not None:
            yield out

    placed = rows.repartition("g").sortWithinPartitions("g")
    return placed.mapInArrow(common.trimmed(run), "a long, b long, far int")


def fingerprint_links(fps: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (fp long) within the budget."""
    rows = _grouped(fps, budget, group_rows)
    return _joined(rows.select(F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), F.col("fp").alias("id"), "g", "side"), budget, "tie").select("a", "b")


def _tables(n: int) -> np.ndarray:
    """Bits sampled by each table: as many bits as leave some ``BUCKET`` of n
    fingerprints in a bucket, as many tables as find a pair of the least
    similarity with probability ``RECALL``."""
    cosine = 2 * SIMILARITY / (1 + SIMILARITY)
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2) / BUCKET))))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(4 * BITS, bits, replace=False) for _ in range(tables)])


def wide_links(prints: DataFrame, budget: int = WIDE_BUDGET, group_rows: int = GROUP_ROWS, *, how: str = "tree", picks: np.ndarray | None = None, rows: int | None = None) -> DataFrame:
    """(a, b, far): candidates among distinct texts (id, fp, ...): pairs within the
    budget, found where a table's sampled bits agree, all of them or those of a
    bucket's spanning forest. Buckets above ``group_rows`` are parted into chunks
    of which each pair is joined by a task of its own; they are known by the ids
    of a sample, as which buckets are parted changes no result."""
    rows = prints.count() if rows is None else rows
    picks = _tables(rows) if picks is None else picks
    names = [c for c in prints.columns if c != "g"]
    weights = np.zeros((4 * BITS, len(picks)))
    for t, pick in enumerate(picks):
        weights[pick, t] = 2.0 ** np.arange(len(pick))
    salt = np.arange(1, len(picks) + 1, dtype=np.uint64) * _MIX[0]

    def dealt(columns: list[str]):
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 1 << 12):
                    part = batch.slice(lo, 1 << 12)
                    bits = np.unpackbits(np.frombuffer(b"".join(part.column(names.index("fp")).to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)
                    g = ((bits.astype(np.float64) @ weights).astype(np.uint64) ^ salt).view(np.int64)  # sums below 2**48: exact
                    for t in range(len(picks)):
                        yield pa.RecordBatch.from_arrays([*[part.column(names.index(c)) for c in columns], pa.array(np.ascontiguousarray(g[:, t]))], [*columns, "g"])

        return run

    def tabled(df: DataFrame, columns: list[str]) -> DataFrame:
        schema = df.select(*columns, F.lit(0).cast("long").alias("g")).schema
        return df.select(*names).mapInArrow(common.trimmed(dealt(columns)), schema)

    spread = tabled(prints, names)
    if rows > group_rows:  # below, no bucket can be large
        share = max(1, min(64, group_rows // 64))
        least = group_rows // share if share == 1 else group_rows // share // 2
        some = prints.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(share)) == 0)
        sizes = tabled(some, ["id"]).groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > least)
        large = common.written(sizes.select("g", F.ceil(F.col("n") * share / group_rows + 1).cast("int").alias("chunks")), "simhash-large")
        if not large.isEmpty():
            plain = spread.join(large, "g", "left_anti").select(*names, "g", F.lit(None).cast("int").alias("side"))
            return _joined(plain.unionByName(_chunked(spread.join(large, "g"), names)), budget, how)
    return _joined(spread.withColumn("side", F.lit(None).cast("int")), budget, how)


def _chunked(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows (id, ..., g, chunks) of a large group, once for each pair of chunks."""
    own = rows.withColumn("c", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int"))
    pairs = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("c") < F.col("o"), 0).when(F.col("c") > F.col("o"), 1).cast("int")
    return pairs.select(*names, F.xxhash64("g", F.least("c", "o"), F.greatest("c", "o")).alias("g"), side.alias("side"))


# ------------------------------------------------------------- components


def connected(links: DataFrame) -> DataFrame:
    """(node, label): nodes of one component share its smallest node as label.

    Links (a, b) are rewritten until each points straight at its component's
    smallest node: every node takes the smallest neighbour it knows of, then
    jumps to that one's label. The rounds grow with the logarithm of the longest
    path; sums and minima are pre-aggregated, and joins are plain equi-joins
    that adaptive execution splits where a node is hot."""
    edges = common.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    # a node that many groups tie to different roots keeps its smallest one, and
    # its other roots are tied to that: about a link a node is left
    for _ in range(2):
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        roots = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = common.written(low.withColumnRenamed("m", "b").unionByName(roots).distinct(), "cc-stars")
    both = common.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-both")
    labels = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        ups = labels.select(F.col("node").alias("label"), F.col("label").alias("up")).join(labels.select("label").distinct(), "label", "left_semi")
        jumped = _salted(labels, ups, "label", "node").select("node", F.least("label", "up").alias("label"))
        jumped = common.written(jumped, "cc-jump")
        seen = _salted(both, jumped.select(F.col("node").alias("b"), "label"), "b", "a").groupBy("a").agg(F.min("label").alias("m"))
        # the root hears of what its members have seen, too
        told = jumped.join(seen, jumped["node"] == seen["a"]).select("node", "label", "m")
        hook = told.groupBy("label").agg(F.min("m").alias("low")).withColumnRenamed("label", "root")
        new = told.join(hook, told["node"] == hook["root"], "left").select("node", F.least("label", "m", "low").alias("label"), F.col("label").alias("was"))
        new = common.written(new, "cc-labels")
        done = new.filter("label <> was").isEmpty() and jumped.join(labels.withColumnRenamed("label", "before"), "node").filter("label <> before").isEmpty()
        common.forget(labels)
        common.forget(jumped)
        labels = new
        if done:
            common.forget(both)
            return labels.select("node", "label")
        labels = common.same(labels.select("node", "label"), labels)


def _salted(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """left joined to right, which has a row a key: a hot key's rows of left are
    dealt by ``spread`` to ``SALT`` copies of its row."""
    copies = right.withColumn("__salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(copies, [key, "__salt"]).drop("__salt")


def components(docs: DataFrame, n_words: int = WORDS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, tie, whole, fp, component_id, component): a row for each document;
    component is the smallest fingerprint of all that hang together."""
    prints = common.written(fingerprints(docs, n_words, id_col, text_col), "simhash")
    least = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    return _named(prints, least, "fp", fingerprint_links(least.select("fp"), budget, group_rows))


def _named(prints: DataFrame, least: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """prints with component and component_id, from links between the distinct keys."""
    named = least.join(connected(links).withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("label", key)).drop("label")
    lowest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return prints.join(_salted(named, lowest, "component", key).select(key, "component_id", "component"), key)


def similar(x: bytes, y: bytes) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of at least ``SIMILARITY``."""
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _set_id(s: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s, SEED)).view(np.int64))


def _few(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if they are few; as they are beyond."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _sets(docs: DataFrame, least: DataFrame, pairs: DataFrame, n_words: int) -> DataFrame:
    """(id, s): the sets of the texts that the pairs name, as sorted 32-bit hashes
    of their shingles, from one document of each text."""

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                h = np.unique(shingle_hashes(t, n_words))
                s = np.unique((h >> np.uint64(32)).astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(h.tobytes())], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["id", "s"])

    needed = common.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "simhash-needed")
    first = common.written(least.join(needed, "id").select(F.col("least_id").alias("first")).distinct(), "simhash-first")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.join(_few(first), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("text")
    sets = own.mapInArrow(common.trimmed(run), "id long, s binary")
    return common.written(sets.join(_few(needed), "id", "left_semi").dropDuplicates(["id"]), "simhash-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) of each pair of texts' ids, by their sets."""

    def run(batches):
        for batch in batches:
            ok = [similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    sided = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return common.written(sided.select("a", "b", "x", "y").mapInArrow(common.trimmed(run), "a long, b long, ok boolean"), "simhash-verified")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, far) with a < b."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "far").filter("a <> b").groupBy("a", "b").agg(F.min("far").alias("far"))


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs whose nodes are of different parts (id, part); those of a node
    without a part are apart."""
    p, q = part.select(F.col("id").alias("a"), F.col("part").alias("p")), part.select(F.col("id").alias("b"), F.col("part").alias("q"))
    rows = pairs.join(p, "a", "left").join(q, "b", "left")
    return rows.filter(F.coalesce("p", "a") != F.coalesce("q", "b")).select(*pairs.columns)


def _marked(sets: DataFrame) -> DataFrame:
    """(id, bits): a bit for each of ``MARKS`` values that a member of the set takes."""

    def run(batches):
        for batch in batches:
            out = []
            for s in batch.column(1).to_pylist():
                bits = np.zeros(MARKS, np.uint8)
                bits[np.frombuffer(s, np.uint32) % MARKS] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bits"])

    return sets.select("id", "s").mapInArrow(common.trimmed(run), "id long, bits binary")


def similar_components(docs: DataFrame, n_words: int = WIDE_WORDS, budget: int = WIDE_BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, tie, whole, id, component_id, component): texts whose sets of
    ``n_words`` shingles have a Jaccard similarity of at least ``SIMILARITY`` are
    linked. A text goes by ``id``, a 64-bit hash of its set.

    Wide fingerprints of the sets only propose links; each is verified on the
    sets. Buckets propose spanning forests, the nearest first. Of those every
    text's nearest is verified, then those that still join different parts. Where
    a link failed, its texts and all that hang together with them are joined once
    more, with marks of their sets that rule out most pairs which are no links:
    a forest of the parts first, and where some of that fails, too, all pairs that
    are left between parts."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, n_words)) for t in batch.column(3).to_pylist()]
            own = [pa.array([wide_fingerprint(h) for h in sets], pa.binary()), pa.array([_set_id(h.tobytes()) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *own], ["doc_id", "tie", "whole", "fp", "id", "n"])

    wide = keyed(docs).mapInArrow(common.trimmed(run), "doc_id long, tie long, whole long, fp binary, id long, n int")
    prints = common.written(wide, "simhash-wide")
    least = common.written(prints.groupBy("id").agg(F.min("doc_id").alias("least_id"), F.min("fp").alias("fp"), F.min("n").alias("n")), "simhash-distinct")
    rows = least.count()
    picks = _tables(rows)
    seen = common.written(_ordered(wide_links(least.select("id", "fp", "n"), budget, group_rows, picks=picks, rows=rows)), "simhash-pairs")
    sets = _sets(docs, least, seen, n_words)
    ends = seen.select("a", "b", "far", F.explode(F.array("a", "b")).alias("id"))
    nearest = ends.groupBy("id").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    tried = _verified(nearest, sets)
    more = _apart(seen.join(tried, ["a", "b"], "left_anti"), _parts(tried.filter("ok")))
    tried = tried.unionByName(_verified(more, sets))
    if not tried.filter("not ok").isEmpty():
        # an untried link of two parts lay in a bucket whose forest joined them by
        # links of which some failed: both parts have an end of one that did
        tied = _parts(tried.filter("ok"))
        failed = tried.filter("not ok").select(F.explode(F.array("a", "b")).alias("id")).distinct()
        failed = common.written(failed.join(tied, "id", "left").select("id", F.coalesce("part", "id").alias("part")), "simhash-failed")
        open_ = tied.join(failed.select("part").distinct(), "part", "left_semi").select("id").unionByName(failed.select("id")).distinct()
        part = common.written(open_.join(tied, "id", "left").select("id", F.coalesce("part", "id").alias("part")), "simhash-parts")
        marked = common.written(least.select("id", "fp", "n").join(part, "id").join(_marked(sets), "id"), "simhash-marked")
        n = marked.count()
        new = _ordered(wide_links(marked, budget, group_rows, picks=picks, rows=n)).join(tried, ["a", "b"], "left_anti")
        again = _verified(common.written(new, "simhash-pairs"), sets)
        tried = tried.unionByName(again)
        if not again.filter("not ok").isEmpty():
            part = common.written(part.select("id").join(_parts(tried.filter("ok")), "id", "left").select("id", F.coalesce("part", "id").alias("part")), "simhash-parts")
            rest = _ordered(wide_links(marked.drop("part").join(part, "id").select(*marked.columns), budget, group_rows, how="all", picks=picks, rows=n))
            tried = tried.unionByName(_verified(common.written(rest.join(tried, ["a", "b"], "left_anti"), "simhash-pairs"), sets))
    links = common.written(tried.filter("ok").select("a", "b"), "simhash-links")
    common.forget(sets)
    return _named(prints.select("doc_id", "tie", "whole", "id"), least.select("id", "least_id"), "id", links)


def _parts(links: DataFrame) -> DataFrame:
    return common.written(connected(links.select("a", "b")).select(F.col("node").alias("id"), F.col("label").alias("part")), "simhash-tied")


def keep_first(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest
    id, null last; of several rows with that id the one of the smallest text hash,
    then of the smallest hash of all columns; of equal rows one. ``found`` are the
    components of these docs."""
    found = common.written(components(docs) if found is None else found, "simhash-found")
    name = F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "tie", "whole")
    best = found.groupBy("component", name.alias("best")).agg(F.count("*").alias("copies")).groupBy("component").agg(F.min(F.struct("best", "copies")).alias("b"))
    keys = ["__null", "__doc", "__tie", "__whole"]
    best = common.written(best.select(*[F.col(f"b.best.{k[2:]}").alias(k) for k in keys], F.col("b.copies").alias("__copies")), "simhash-best")
    named = docs.select("*", F.col("doc_id").isNull().alias("__null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__doc"), F.xxhash64(F.col("text").cast("string")).alias("__tie"), F.xxhash64(*[F.col(c) for c in docs.columns]).alias("__whole"))
    kept = named.join(best, keys)
    out = kept.filter("__copies = 1").select(*docs.columns)
    if best.filter("__copies > 1").isEmpty():
        return out
    return out.unionByName(kept.filter("__copies > 1").dropDuplicates(keys).select(*docs.columns))  # equal rows


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
