"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

Texts and benchmark items are sequences of words. The CGK random walk embeds a
sequence of n words into a longer one: at step j it writes the word it stands
on and moves on if that word's random bit for step j is set. Sequences of small
edit distance fall into step again after each edit, so few positions of the
embeddings differ. A repetition draws a walk and ``SAMPLES`` positions; a window
of the text, begun at any word, is a candidate for the items that agree with it
at all of them. Positions are looked at in order through a trie of the items'
values, and a window is dropped at its first value that no item has there, which
changes nothing in the outcome. Repetitions are added until simulated edits of
the items themselves, ``MOST_EDITS`` of their words, are found with probability
``RECALL``; where ``MORE_AFTER`` of them don't reach it, as with long items, the
next ones have a sample less. Candidates are then verified by the exact word-level
edit distance between the item and the best-ending window at that start.

Words that no item has are one symbol, which leaves every edit distance to an
item as it is; a window that begins with such a word can't beat the one that
begins behind it and is not tried, nor is one with too few words of items for any
match. Items are walked in classes of like size, so
windows are item-sized. An item of more than ``PIECE`` words is parted into pieces
of nearly equal size: of a match with at most ``MOST_EDITS`` of the words in edits
one piece at least has no more than that share, so the pieces are searched for like
items of their own, verified, and the whole item is then aligned around each hit
with both ends free. Windows and walks are bounded, whatever the items' lengths.

A walk's random bits are a hash of repetition, step and word, so a repetition is a
few numbers and its trie. A pass is a map over the documents: nothing is shuffled.
Items are dealt by a hash into slabs of about ``SLAB_WORDS`` words, each a pass; a
slab's words, pieces and tries, which the driver builds in array operations, are
what is broadcast, about ``(16 + 40 * repetitions / words an item)`` bytes a word:
under 300 MB for the shortest items, 30 MB for those of 50 words.

Defined results: documents are searched whole, very long ones in batches of windows
of bounded size; null and empty texts and items match nothing, nor do items of
fewer than ``least_words`` words (1 by default; a one-word item is found wherever
its word is, so corpora are cleaned with ``LEAST_WORDS``) unless ``short_lines``
is set: such an item then matches exactly, where its words are all the words of one
line or of several lines in a row, since within a sentence a few words are no sign
of the benchmark; an item matches with at
most ``MOST_EDITS`` of its words in edits, so very short ones must be exact; per
document row and item the window with the fewest edits is reported, the first of
several; repeated document ids are searched as separate rows, repeated items as
separate items; empty tables give no rows; of the documents' columns those named
are kept, one called as a column of the result with ``doc_`` before its name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .toxicity import word_hashes

MOST_EDITS = 0.2
RECALL = 0.95
SAMPLES = 4
MORE_AFTER = 64
TRIALS = 256
SEED = 11
PIECE = 63
LEAST_WORDS = 5
SLAB_WORDS = 1 << 20
BATCH_CHARS = 1 << 20
CHUNK = 1 << 16
CELLS = 1 << 22

COLUMNS = "item_id long, start_word long, n_words long, edits int, item_words int"
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _bits(h: np.ndarray, key: np.uint64) -> np.ndarray:
    """64 random bits of each word, those of 64 steps of a walk."""
    x = (h ^ key) * _MIX[0]
    x ^= x >> np.uint64(32)
    x *= _MIX[1]
    x ^= x >> np.uint64(29)
    return x


class Repetition:
    """A walk, the steps sampled, and the trie of the items' values there."""

    def __init__(self, steps: int, rng, samples: int):
        self.steps = steps
        self.at = np.sort(rng.choice(steps, min(samples, steps), replace=False))
        self.keys = rng.integers(0, 1 << 63, -(-steps // 64), dtype=np.uint64)

    def values(self, sym: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Symbols that the walks along each row of sym, with its words' hashes,
        stand on at the sampled steps; -1 behind the row's end, as sym has there."""
        m, width = sym.shape
        flat, base, p, out = sym.ravel(), np.arange(m) * width, np.zeros(m, np.int64), []
        moves, j = None, 0
        for at in self.at.tolist():
            while j < at:
                if j % 64 == 0:
                    moves = _bits(h, self.keys[j // 64]).ravel()
                p += (moves[base + p] >> np.uint64(j % 64) & np.uint64(1)).view(np.int64)
                j += 1
            out.append(flat[base + p])
        return np.stack(out, axis=1)

    def plant(self, values: np.ndarray, items: np.ndarray, v: int) -> None:
        """The trie of the items whose every value is a word."""
        self.v, self.levels = v, []
        whole = (values >= 0).all(axis=1)
        values, items = values[whole], items[whole]
        node = np.zeros(len(items), np.int64)
        for level in range(len(self.at)):
            keys, node = np.unique(node * v + values[:, level], return_inverse=True)
            self.levels.append(keys)
        order = np.argsort(node, kind="stable")
        self.items, self.first = items[order].astype(np.int32), np.searchsorted(node[order], np.arange(len(self.levels[-1]) + 1)).astype(np.int32)

    def candidates(self, sym: np.ndarray, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of windows that agree with a piece at all samples; sym
        and h are padded by ``steps`` symbols."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.items):
            return none
        moves = [_bits(h, k) for k in self.keys]
        table = np.full(self.v, -1, np.int64)  # the first level: all symbols at once
        table[self.levels[0]] = np.arange(len(self.levels[0]))
        found_s, found_i = [], []
        for lo in range(0, len(starts), CHUNK):
            p = starts[lo : lo + CHUNK].copy()
            s, node, j = p.copy(), None, 0
            for level, at in enumerate(self.at.tolist()):
                while j < at:
                    step = moves[j // 64].take(p)
                    step >>= np.uint64(j % 64)
                    step &= np.uint64(1)
                    p += step.view(np.int64)
                    j += 1
                key, keys = sym.take(p), self.levels[level]
                if node is None:
                    node = table[key]
                    ok = np.flatnonzero(node >= 0)
                else:
                    key = node * self.v + key
                    node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    ok = np.flatnonzero(keys[node] == key)
                p, s, node = p[ok], s[ok], node[ok]
                if not len(p):
                    break
            if len(p):
                first = self.first.astype(np.int64)
                n = first[node + 1] - first[node]
                found_s.append(np.repeat(s, n))
                found_i.append(self.items[np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        return (np.concatenate(found_s), np.concatenate(found_i).astype(np.int64)) if found_s else none


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    """The rows side by side, -1 behind their ends."""
    out = np.full((len(rows), width), -1, np.int64)
    sizes = np.array([len(r) for r in rows])
    if len(rows):
        out[np.arange(width) < sizes[:, None]] = np.concatenate(rows)
    return out


class Index:
    """The items of one slab: symbols, pieces, repetitions by class of size."""

    def __init__(self, ids: list, texts: list[str | None], least_words: int = 1, short_lines: bool = False):
        h, ends = word_hashes(texts)
        self.vocab = np.unique(h)
        self.oov = len(self.vocab)
        code = np.searchsorted(self.vocab, h)
        self.words = np.split(code, ends[:-1]) if len(ends) else []
        self.ids = ids
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.most = (self.sizes * MOST_EDITS).astype(np.int64)
        # pieces: item, first word, words; short: the items looked for as whole lines
        rows, self.short = [], {}
        for i, n in enumerate(self.sizes.tolist()):
            if short_lines and 0 < n < least_words:
                self.short.setdefault(n, {}).setdefault(self.words[i].tobytes(), []).append(i)
            if n >= max(1, least_words):
                k = -(-n // PIECE)
                cuts = [n * c // k for c in range(k + 1)]
                rows += [(i, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pieces = np.array(rows, np.int64).reshape(-1, 3)
        low = 1 << np.frexp(np.maximum(self.pieces[:, 2], 1))[1].astype(np.int64) - 1
        #: the sizes of each class's pieces, and its repetitions
        self.classes = [(np.unique(self.pieces[low == c, 2]).tolist(), self._repetitions(c, np.flatnonzero(low == c))) for c in np.unique(low).tolist()]

    @property
    def reps(self) -> list[Repetition]:
        return [rep for _, reps in self.classes for rep in reps]

    @staticmethod
    def dense(sizes: list[int], sym: np.ndarray, oov: int, known: np.ndarray) -> np.ndarray:
        """The starts whose windows have words enough that some item has: a piece of
        n words with at most m edits keeps n - m of them within n + m words."""
        upto = np.concatenate([[0], np.cumsum(sym < oov)])
        ok = np.zeros(len(known), bool)
        for n in sizes:
            most = int(n * MOST_EDITS)
            ok |= upto[np.minimum(known + n + most, len(sym))] - upto[known] >= n - most
        return known[ok]

    def piece(self, k: int) -> np.ndarray:
        i, first, n = self.pieces[k].tolist()
        return self.words[i][first : first + n]

    def _repetitions(self, low: int, own: np.ndarray) -> list[Repetition]:
        """As many as find a piece of low to 2 * low - 1 words with ``MOST_EDITS``
        of them in edits, as simulated with random edits and words behind."""
        steps = max(1, int(2 * low - 2 * math.sqrt(low))) if low > 1 else 1
        rng, dice = np.random.default_rng([SEED, low]), np.random.default_rng([SEED, low, 1])
        width = max(2 * low, steps) + 1
        rows = _padded([self.piece(k) for k in own.tolist()], width)
        owner, edited = dice.choice(len(own), TRIALS), []
        for k in own[owner].tolist():
            x = self.piece(k).tolist()
            for _ in range(int(len(x) * MOST_EDITS)):
                at, kind = int(dice.integers(len(x))), int(dice.integers(3))
                new = self.oov if dice.random() < 0.5 else int(dice.integers(self.oov))
                x[at : at + (kind != 1)] = [new] if kind != 2 else []
            edited.append(np.array(x + dice.integers(0, self.oov + 1, steps + 1).tolist(), np.int64))
        trials = _padded(edited, max(map(len, edited)))
        hashes, trial_hashes = self.hashes(rows), self.hashes(trials)
        reps, missed = [], np.ones(TRIALS, bool)
        while not reps or missed.mean() > 1 - RECALL:
            samples = SAMPLES - len(reps) // MORE_AFTER
            if not samples:
                raise RuntimeError(f"items of {low} words and more: {missed.mean():.0%} of simulated edits are missed")
            rep = Repetition(steps, rng, samples)
            values = rep.values(rows, hashes)
            missed &= ((rep.values(trials, trial_hashes) != values[owner]) | (values[owner] < 0)).any(axis=1)
            rep.plant(values, own, self.oov + 1)
            reps.append(rep)
        return reps

    def hashes(self, sym: np.ndarray) -> np.ndarray:
        """The words' hashes; words that no item has share one."""
        return np.append(self.vocab, np.uint64(0))[sym]

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not self.oov:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), self.oov - 1)
        return np.where(self.vocab[at] == h, at, self.oov)

    def search(self, texts: list[str | None]):
        """(text, item, start word, words, edits) arrays, one row a text and item."""
        h, ends = word_hashes(texts)
        sym = self.symbols(h)
        known = np.flatnonzero(sym < self.oov)
        padded = np.concatenate([sym, np.full(max((r.steps for r in self.reps), default=0) + 1, self.oov)])
        hashes, n = self.hashes(padded), max(1, len(self.pieces))
        pairs = [np.zeros(0, np.int64)]
        for sizes, reps in self.classes:
            starts = self.dense(sizes, sym, self.oov, known)
            for rep in reps:
                s, k = rep.candidates(padded, hashes, starts)
                pairs.append(np.unique(s * n + k))
        pairs = np.unique(np.concatenate(pairs))
        s, k = pairs // n, pairs % n
        doc = np.searchsorted(ends, s, side="right")
        first = np.concatenate([[0], ends])
        most = (self.pieces[k, 2] * MOST_EDITS).astype(np.int64)
        edits, length = self._aligned(k, self.piece, self.pieces[k, 2], most, sym, s, ends[doc])
        ok = edits <= most
        doc, k, s, length, edits = (v[ok] for v in (doc, k, s, length, edits))
        i = self.pieces[k, 0]
        part = self.pieces[k, 2] < self.sizes[i]
        whole = self._wholes(doc[part], i[part], s[part] - self.pieces[k[part], 1], sym, first)
        lines = self._lines(texts, sym, ends)
        doc, i, s, length, edits = (np.concatenate([a[~part], b, c]) for a, b, c in zip((doc, i, s, length, edits), whole, lines, strict=True))
        order = np.lexsort((s, edits, i, doc))
        doc, i, s, length, edits = (v[order] for v in (doc, i, s, length, edits))
        best = np.ones(len(doc), bool)
        best[1:] = (doc[1:] != doc[:-1]) | (i[1:] != i[:-1])
        return doc[best], i[best], s[best] - first[doc[best]], length[best], edits[best]

    def _lines(self, texts: list[str | None], sym: np.ndarray, ends: np.ndarray):
        """Rows of the short items whose words are all those of lines in a row."""
        out = [[] for _ in range(5)]
        if self.short:
            # newlines part words, so the words of the lines are those of the texts
            stops = np.unique(word_hashes([line for t in texts for line in (t or "").split("\n")])[1])
            starts = np.unique(np.concatenate([[0], stops]))
            owner = np.searchsorted(ends, starts, side="right")
            limit = np.append(ends, 0)[owner]  # nothing behind the last word
            for n, items in self.short.items():
                for at in np.flatnonzero((starts + n <= limit) & np.isin(starts + n, stops)).tolist():
                    begin = int(starts[at])
                    for item in items.get(sym[begin : begin + n].tobytes(), ()):
                        for a, v in zip(out, (int(owner[at]), item, begin, n, 0), strict=True):
                            a.append(v)
        return [np.array(a, np.int64) for a in out]

    @staticmethod
    def _aligned(k: np.ndarray, words, sizes: np.ndarray, most: np.ndarray, sym, start, stop):
        """Edits and window words of each (piece, start), those of one size together."""
        edits, length = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            e = int(most[at[0]])
            step = max(1, min(4096, CELLS // (2 * e + 1)))
            for lo in range(0, len(at), step):
                q = at[lo : lo + step]
                edits[q], length[q] = edit_distances(np.stack([words(j) for j in k[q].tolist()]), sym, start[q], stop[q], e)
        return edits, length

    def _wholes(self, doc, i, start, sym, first):
        """Rows of whole items around hits of their pieces: starts that differ by
        less than half the edits allowed are one alignment, its band that wider."""
        out = [[] for _ in range(5)]
        if len(doc):
            wide = np.maximum(1, self.most[i] // 2)
            keys = np.unique(np.stack([doc, i, start // wide], axis=1), axis=0)
            for d, item, at in keys.tolist():
                most, step = int(self.most[item]), max(1, int(self.most[item]) // 2)
                band = most + step
                x, lo, hi = self.words[item], int(first[d]), int(first[d + 1])
                found = free_alignment(x, sym[lo:hi], at * step - lo, band, most)
                if found:
                    for a, v in zip(out, (d, item, found[0] + lo, found[1], found[2]), strict=True):
                        a.append(v)
        return [np.array(a, np.int64) for a in out]


def free_alignment(x: np.ndarray, text: np.ndarray, start: int, band: int, most: int) -> tuple[int, int, int] | None:
    """(first word, words, edits) of the window of text that x differs from
    least, begun and ended within the band around start; None beyond ``most``."""

    def ends(x: np.ndarray, text: np.ndarray, start: int, free: bool) -> tuple[int, int]:
        """The least edits of a path through the band and where it ends."""
        edits, length = edit_distances(x[None], text, np.array([start]), np.array([len(text)]), band, free=free, most=most)
        return int(edits[0]), start + int(length[0])

    edits, end = ends(x, text, start, True)
    if edits > most:
        return None
    # the same window from its end, which tells where it begins
    edits, back = ends(x[::-1], text[:end][::-1], 0, False)
    return (end - back, back, edits) if edits <= most else None


def edit_distances(x: np.ndarray, sym: np.ndarray, start: np.ndarray, stop: np.ndarray, band: int, *, free: bool = False, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least edits, and the window's words, between each row of x and the text
    from start on, ending anywhere before stop: a band of ``band`` on each side.
    With ``free`` the window may begin anywhere in the band, too, a negative start
    counting from before the text. Distances above ``most`` (the band by default)
    come out as some number above it."""
    m, n = x.shape
    most = band if most is None else most
    w, left = np.arange(2 * band + 1), (stop - start)[:, None]
    far = 2 * (n + band + 1)
    least = (-start if free else np.zeros(m, np.int64))[:, None]  # the first column that is in the text, or the window

    def valid(row: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.where((j >= least) & (j <= left), row, far)

    # row i of the table at columns j = i + w - band
    row = valid(np.broadcast_to(0 if free else np.abs(w - band), (m, len(w))).astype(np.int64), w - band)
    for i in range(1, n + 1):
        j = i + w - band
        same = sym[np.clip(start[:, None] + j - 1, 0, len(sym) - 1)] == x[:, i - 1 : i] if len(sym) else np.zeros((m, len(w)), bool)
        best = np.where(j >= least + 1, row + ~same, far)
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        row = valid(np.minimum.accumulate(valid(best, j) - w, axis=1) + w, j)
        if i % 64 == 0 and row.min() > most:  # minima of rows never fall
            break
    end = row.argmin(axis=1)
    return row[np.arange(m), end], n + end - band


def _slabs(benchmark: DataFrame, least_words: int, short_lines: bool):
    """The benchmark's indexes, each of about SLAB_WORDS words, broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    words = items.agg(F.coalesce(F.sum(common.word_count(F.col("text"))), F.lit(0))).first()[0]
    n = max(1, -(-words // SLAB_WORDS))
    for slab in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == slab).orderBy("item_id", "text").collect()  # a slab's words
        yield benchmark.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], least_words, short_lines))


def _searched(batch: pa.RecordBatch, column: int, index: Index):
    """(row, item, start, words, edits) arrays of each run of a batch's texts."""
    texts = batch.column(column).to_pylist()
    lo = held = 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= BATCH_CHARS or k == len(texts) - 1:
            row, *found = index.search(texts[lo : k + 1])
            yield row + lo, *found
            lo, held = k + 1, 0


def matches(docs: DataFrame, benchmark: DataFrame, columns: list[str], text_col: str = "text", least_words: int = 1, short_lines: bool = False) -> DataFrame:
    """The named columns of each document that holds an item, with item_id,
    start_word, n_words (of the window), edits and item_words."""
    found = docs.sparkSession.createDataFrame([], COLUMNS).schema
    kept = []
    for c in columns:
        name = c
        while name in found.names or name in kept:
            name = f"doc_{name}"
        kept.append(name)
    picked = docs.select(*[F.col(c).alias(k) for c, k in zip(columns, kept, strict=True)], F.col(text_col).cast("string").alias("__text"))
    n, schema = len(columns), picked.drop("__text").schema
    for field in found:
        schema = schema.add(field)
    names, out = schema.names, None

    def searcher(sent):
        def run(batches):
            index = sent.value
            for batch in batches:
                for row, item, start, length, edits in _searched(batch, n, index):
                    own = [pa.array([index.ids[i] for i in item.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array(edits.astype(np.int32)), pa.array(index.sizes[item].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns[:n], *own], names)

        return run

    for sent in _slabs(benchmark, least_words, short_lines):
        part = picked.mapInArrow(common.trimmed(searcher(sent)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least_words: int = 1, short_lines: bool = False) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    columns, schema = docs.columns, docs.schema

    def keeper(sent):
        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in _searched(batch, columns.index(text_col), sent.value):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        return run

    for sent in _slabs(benchmark, least_words, short_lines):
        docs = docs.mapInArrow(common.trimmed(keeper(sent)), schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"], least_words=LEAST_WORDS, short_lines=True)
