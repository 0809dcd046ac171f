"""The corpus pipeline: toxic documents go, near-duplicates are folded, documents
that hold benchmark items go, sources are mixed to their weights, and the ids of
what is left are coded, written and read back.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the shared folder and rereads it as the next stage's documents. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common, decontaminate, mixing, rans, simhash, toxicity


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from ``labels``."""
    rows = toxicity.scored(docs, common.table(spark, sf_dir, "labels"), docs.columns, name="__score")
    return rows.filter(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies:
    texts whose five-word shingles are similar by 0.8 or more."""
    return simhash.keep_first(docs, simhash.similar_components(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` is found; items of fewer than
    ``LEAST_WORDS`` words are found where they are whole lines."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"), least_words=decontaminate.LEAST_WORDS, short_lines=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of each document that its source's target takes."""
    return mixing.emitted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document kept, coded, written and read back."""
    return rans.round_trip(docs)


STAGES = [("toxicity", nontoxic), ("simhash", deduplicated), ("decontaminate", decontaminated), ("mixing", mixed), ("rans", tokens)]

#: Training, fingerprints and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{name}")
    return docs
