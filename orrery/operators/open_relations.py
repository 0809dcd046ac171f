"""Triples without a model: open relation extraction, counted over the corpus.

A sentence is cut into runs of argument words (rare in the corpus, of some length,
not numbers) and of other words. Two runs of arguments with a short run of other
words between them are a candidate: subject, relation phrase, object. A phrase is a
relation if it joins enough different pairs (a phrase seen with one pair only is part
of a name, or chance), and a triple is the surer the more its phrase supports and the
more sentences say it. Runs are found within a sentence's row; a phrase that a third of
all candidates has is counted before it is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session, storage
from ..functions import text as T
from ..functions.batches import pieces

#: Arguments are words of so many letters, in at most this share of sentences.
LETTERS, SHARE = 4, 0.002
#: Words of an argument and of a relation phrase at most.
SPAN, PHRASE = 3, 4
#: Different pairs that a relation joins at least.
SUPPORT = 3


def sentence_words(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source_doc, words, low): each sentence's words in order, as they are and
    without case. Null and empty texts have none."""
    rows = chunks.select("chunk_id", F.col("source").alias("source_doc"), F.explode(T.split_sentences(F.col("content"))).alias("sentence"))
    rows = rows.select("chunk_id", "source_doc", T.tokenize(F.col("sentence")).alias("words")).filter(F.size("words") > 0)
    return rows.withColumn("low", F.transform("words", F.lower))


def common_words(sentences: DataFrame, share: float = SHARE) -> list[str]:
    """Words, without case, in more than that share of sentences, and in two at least. A
    sentence of so many different words adds to as many, so there are at most the mean
    sentence's words over the share: they may be sent to all tasks, as those that are
    rare, and all others, may not."""
    n = sentences.count()
    held = sentences.select(F.explode(F.array_distinct("low")).alias("low")).groupBy("low").agg(F.count("*").alias("df"))
    return [r.low for r in held.filter((F.length("low") >= LETTERS) & (F.col("df") > max(1.0, share * n))).select("low").collect()]


def _phrases(words: pa.Array, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words from each place on, so many of them, with blanks between."""
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(at))), " ")


def candidates(sentences: DataFrame, common: list[str]) -> DataFrame:
    """(chunk_id, source_doc, subject, relation, object), the relation in lower case.
    A sentence is one row, so its runs are found in the task and no word is shuffled."""
    sent = sentences.sparkSession.sparkContext.broadcast(frozenset(common))
    # tokens are letters and digits: of those so long, valid entities are those not all digits
    rare = lambda w: len(w) >= LETTERS and not w.isdecimal() and w not in sent.value

    def run(batches):
        for b in pieces(batches, 2):
            ends = b["words"].offsets.to_numpy().astype(np.int64)
            words, low = (b[c].values.slice(b[c].offsets[0].as_py(), ends[-1] - ends[0]) for c in ("words", "low"))
            held, at = low.dictionary_encode(), np.repeat(np.arange(b.num_rows), np.diff(ends))
            is_arg = np.array([rare(w) for w in held.dictionary.to_pylist()], bool)[held.indices.to_numpy()]
            new = np.concatenate([[True], (is_arg[1:] != is_arg[:-1]) | (at[1:] != at[:-1])])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at)))
            fits = is_arg[first[:-2]] & (at[first[:-2]] == at[first[2:]]) & (size[:-2] <= SPAN) & (size[1:-1] <= PHRASE) & (size[2:] <= SPAN)
            r = np.flatnonzero(fits)
            said = [_phrases(words, first[r + k], size[r + k]) for k in range(3)]
            row = pa.array(at[first[r]])
            yield pa.RecordBatch.from_arrays([b["chunk_id"].take(row), b["source_doc"].take(row), *said], ["chunk_id", "source_doc", "subject", "relation", "object"])

    schema = sentences.select("chunk_id", "source_doc", *[F.lit("").alias(c) for c in ("subject", "relation", "object")]).schema
    return sentences.mapInArrow(run, schema).withColumn("relation", F.lower("relation"))


def extracted(chunks: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """(chunk_id, source_doc, subject, relation, object, support, evidence, confidence)
    of (chunk_id, source, content): a row for each sentence that says a triple, with
    the different pairs its relation joins, the sentences that say it (without case),
    and 1 - (1 - p)^evidence with p = support / (support + least support).

    Only candidates are written; a phrase seen fewer times than it must join pairs,
    which most are, is left out before pairs are counted."""
    sentences = sentence_words(chunks)
    found = candidates(sentences, common_words(sentences, share)).filter(F.lower("subject") != F.lower("object"))
    found = storage.written(found, "relation-candidates")
    often = found.groupBy("relation").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("relation")
    found = found.join(session.small(storage.written(often, "relation-often")), "relation", "left_semi")
    a, b = F.lower("subject").alias("a"), F.lower("object").alias("b")
    joins = found.select("relation", a, b).distinct().groupBy("relation").agg(F.count("*").alias("support")).filter(F.col("support") >= support)
    found = found.join(session.small(storage.written(joins, "relation-joins")), "relation")
    said = found.groupBy(F.col("relation").alias("r"), a, b).agg(F.count("*").alias("evidence"))
    p = F.col("support") / (F.col("support") + support)
    rows = found.join(said, (F.col("relation") == F.col("r")) & (F.lower("subject") == F.col("a")) & (F.lower("object") == F.col("b")))
    return rows.select("chunk_id", "source_doc", "subject", "relation", "object", "support", "evidence", F.round(1 - F.pow(1 - p, F.col("evidence")), 4).alias("confidence"))


def records(triples: DataFrame, least: float = 0.0) -> DataFrame:
    """Triple records by chunk, as ``kg.clean_triples`` and the build's cache take them."""
    t = F.struct("subject", "relation", "object")
    return triples.filter(F.col("confidence") >= least).groupBy("chunk_id", "source_doc").agg(F.array_sort(F.collect_set(t)).alias("triples"))
