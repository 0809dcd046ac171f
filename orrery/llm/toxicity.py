"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Words are runs of letters and digits, small letters throughout. A document's
features are the hashes of its words, of neighbouring pairs and of pairs one
word apart, each present or absent. The model is trained online, document by
document, with per-coordinate learning rates; L1 leaves most weights at zero, so
what is broadcast is at most 2**HASH_BITS numbers and in practice some thousand.

Training reads about ``SAMPLE_ROWS`` labelled documents, chosen by a hash of
their id and visited in that order, so runs agree. Their features are taken where
the documents are; one task then learns from at most ``SAMPLE_FEATURES`` features
in all, in that order, whatever the texts' lengths. Rows of the held-out
fold (crc32 of the id as text, modulo 3, is 1) are never learned from. Counts of
words and documents play no part: a document of 20,000 words is judged by which
features it has.

Defined results: null and empty texts have no feature and score what the bias
alone gives; a null id is never held out and never trained on; of several labels
of an id the highest holds; of several documents of a labelled id one is learned
from, that of the smallest text hash; labels that are null are not used; without
labels, or with one kind only, every score is that share (0 without any); repeated
ids are separate rows, each scored; an empty table gives no rows; other columns are
ignored, or kept if named, but one called as the score is gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HASH_BITS = 22
#: Bounds of what training reads: labelled documents, and features of all of them.
SAMPLE_ROWS = 16_000
SAMPLE_FEATURES = 1 << 25
EPOCHS = 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.1
#: A feature enters the model if so many documents of the sample have it.
INCLUDE_FROM = 3
THRESHOLD = 0.7
BATCH_CHARS = 1 << 20

_BASE = np.uint64(0x100000001B3)
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Letters and digits of ASCII, and all bytes of other characters, are word bytes.
_IN_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(128)] + [True] * 128)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, past-last word of each text), vectorised:
    a word's hash is a difference of the batch's running polynomial."""
    raw = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    mask = np.zeros(len(buf) + 2, bool)
    mask[1:-1] = _IN_WORD[buf]
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    # sum of byte * base**(distance to the end of the word), within each word
    n = len(buf)
    power = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=power[1:])
    run = np.concatenate([[np.uint64(0)], np.cumsum((buf + np.uint64(1)) * power[n:0:-1], dtype=np.uint64)])
    back = np.uint64(pow(int(_BASE), -1, 1 << 64))
    inverse = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, back), out=inverse[1:])
    h = (run[stop] - run[start]) * inverse[n - stop]
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    return h ^ (h >> np.uint64(29)), np.searchsorted(start, ends)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) pairs of a batch: words, pairs, pairs one word apart."""
    h, ends = word_hashes(texts)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    shift = np.uint64(64 - HASH_BITS)
    out, docs = [h], [doc]
    for gap, k in ((1, _MIX[1]), (2, _MIX[2])):
        same = doc[:-gap] == doc[gap:] if len(doc) > gap else np.zeros(0, bool)
        pair = (h[:-gap] * k + h[gap:])[same] if len(doc) > gap else np.zeros(0, np.uint64)
        pair = (pair ^ (pair >> np.uint64(31))) * _MIX[0]
        out.append(pair)
        docs.append(doc[:-gap][same] if len(doc) > gap else np.zeros(0, np.int64))
    return (np.concatenate(out) >> shift).astype(np.int32), np.concatenate(docs)


def sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct features of each text, ascending."""
    f, d = features(texts)
    pairs = np.unique(d.astype(np.int64) << HASH_BITS | f)
    cut = np.searchsorted(pairs >> HASH_BITS, np.arange(len(texts) + 1))
    return [(pairs[a:b] & ((1 << HASH_BITS) - 1)).astype(np.int32) for a, b in zip(cut, cut[1:], strict=False)]


def batches_of(texts: list[str | None]):
    """(first, past last) of runs of about ``BATCH_CHARS`` characters, a text at least."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= BATCH_CHARS or i == len(texts) - 1:
            yield lo, i + 1
            lo, held = i + 1, 0


def train(own: list[np.ndarray], labels: np.ndarray, *, alpha: float = ALPHA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, least: int = INCLUDE_FROM) -> tuple[np.ndarray, float]:
    """(weights, bias) after ``epochs`` passes over the documents' features, in the given
    order. Features rarer than ``least`` are taken out of the list given."""
    size = 1 << HASH_BITS
    z, n = np.zeros(size), np.zeros(size)
    bias = float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6)))
    often = np.zeros(size, np.int32)
    for x in own:
        often[x] += 1
    for i, x in enumerate(own):  # one after the other, so that two copies of all are never held
        own[i] = x[often[x] >= least]
    del often
    bias_n = 1.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for x, y in zip(own, labels, strict=True):
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            bias_n += g * g
            bias -= alpha * g / (BETA + np.sqrt(bias_n))
            if abs(g) < 1e-4:
                continue
            more = ni + g * g
            z[x] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[x] = more
    out, seen = np.zeros(size), np.flatnonzero(n)
    out[seen] = weights(z[seen], n[seen])
    return out, bias


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "toxic") -> DataFrame:
    """(order, label, features) of about ``rows`` labelled documents outside the
    held-out fold, one an id; the ids are chosen before any text is read."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.col("order") <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else known
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id").select("order", "label", F.xxhash64("text").alias("tie"), "text")  # about SAMPLE_ROWS rows

    def run(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for lo, hi in batches_of(texts):
                got = sets(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:3], pa.array(got, pa.list_(pa.int32()))], ["order", "label", "tie", "features"])

    found = picked.mapInArrow(common.trimmed(run), "order long, label int, tie long, features array<int>")
    return found.groupBy("order").agg(F.min_by(F.struct("label", "features"), "tie").alias("one")).select("order", "one.*")


def model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias): the non-zero weights, trained in one task."""

    def run(batches):
        own, marks, held = [], [], 0
        for batch in batches:  # by their hash order
            ends = batch.column(1).offsets.to_numpy()
            flat, y = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(0).to_pylist()
            for k in range(batch.num_rows):
                more = int(ends[k + 1] - ends[k])
                if held + more <= SAMPLE_FEATURES:  # one very long document leaves room for those after it
                    held += more
                    own.append(flat[ends[k] : ends[k + 1]].copy())
                    marks.append(y[k])
        y = np.array(marks, float)
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.0
            at, w, b = [], [], float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        else:
            dense, b = train(own, y)
            own.clear()
            at = np.flatnonzero(dense)
            w = dense[at]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([b, *w], pa.float64())], ["feature", "weight"])

    # the scan keeps its tasks; only the sample's features move to one
    rows_ = sample(docs, labels, rows, label).repartition(1).sortWithinPartitions("order").select("label", "features")
    got = rows_.mapInArrow(common.trimmed(run), "feature int, weight double").toPandas()  # bounded by 2**HASH_BITS
    if not len(got):
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(1e-9))
    bias = got["feature"] < 0
    return got["feature"][~bias].to_numpy(), got["weight"][~bias].to_numpy(), float(got["weight"][bias].iloc[0])


def scores(texts: list[str | None], dense: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(texts), bias)
    for lo, hi in batches_of(texts):
        f, d = features(texts[lo:hi])
        some = np.flatnonzero(dense[f])  # a few features of each document
        pairs = np.unique(d[some].astype(np.int64) << HASH_BITS | f[some])
        total[lo:hi] += np.bincount(pairs >> HASH_BITS, dense[pairs & ((1 << HASH_BITS) - 1)], hi - lo)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def scored(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int = SAMPLE_ROWS, name: str = "score") -> DataFrame:
    """The named columns of docs with the score added as ``name``."""
    columns = [c for c in columns if c != name]
    at, weight, bias = model(docs, labels, rows)
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weight))

    def run(batches):
        at, weight = sent.value
        dense = np.zeros(1 << HASH_BITS)
        dense[at] = weight
        for batch in batches:
            got = scores(batch.column(len(columns)).to_pylist(), dense, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(got)], [*columns, name])

    picked = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    return picked.mapInArrow(common.trimmed(run), docs.select(*columns, F.lit(0.0).alias(name)).schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
