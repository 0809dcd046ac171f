"""Quality rules with adaptive thresholds, in DataFrame operations only.

One pass gives each document its counts. Quantile sketches (KLL) of four rates
are built by language and source; being mergeable, every task sends one small
sketch a group, so a hot source costs no more than any other, and the sketch of a
language is merged from those of its sources. Their quantiles
are the thresholds that the joined filter applies in place of fixed cut-offs:
a document is kept if it passes the base rules and no rate lies beyond its
group's fence, a counted one by more than a standard deviation of such a count
(``NOISE``), so a single symbol in a group without any is no outlier. A group of fewer than ``LEAST_GROUP`` rows takes its language's
fences; rates are not compared across languages.

Defined results: null and empty texts have no words and fail the base rules; a text
is one row, and its windows one sorted array of it, about 50 bytes a word (a text of
10 MB: 100 MB); null lang or
source form groups of their own; a fence is a value of its group or lies beyond
one, so a uniform group rejects nothing, nor does a language of fewer rows than
make a tail (under ten at 0.9); repeated ids are separate rows; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: The fence of a rate, from its group alone: the tail quantile of TAILS, or
#: median + REACH * (upper quartile - median) where that lies beyond it.
REACH = 6.0
NOISE = 1.0
#: Sketches are exact up to so many values; beyond, ranks are off by about 0.25 %.
SKETCH_K = 1024
LEAST_GROUP = 30
TAILS = {"symbol_rate": 0.9, "dup_line_rate": 0.99, "repeat_rate": 0.99, "word_length": 0.9}


def _repeated(words, n):
    """Words covered by windows of three that the text has twice or more.

    Windows are sorted as (hash, position); equal neighbours are repeats. The
    positions of repeats, sorted, cover min(3, distance to the next) words each."""

    def windows(w):
        return F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.cast("int").alias("p")))

    def repeats(s):
        alike = lambda x, j: j.between(0, F.size(s) - 1) & (F.get(s, j)["h"] == x["h"])
        return F.transform(F.filter(s, lambda x, i: F.coalesce(alike(x, i - 1), F.lit(False)) | F.coalesce(alike(x, i + 1), F.lit(False))), lambda x: x["p"])

    def covered(p):
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    found = common.let(F.array_sort(windows(words)), lambda s: common.let(F.array_sort(repeats(s)), covered))
    return F.when(n >= WINDOW, found).otherwise(F.lit(0)).cast("long")


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD))
    base = docs.select(F.col(id_col).alias("doc_id"), "lang", "source", text.alias("text"))
    bare = F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))
    row = common.let(words_of("text"), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w, F.size(w)).alias("r")))
    dup = common.let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return base.select(
        "doc_id", "lang", "source", row.alias("row"), bare.cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", F.col("row.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("row.r").alias("n_repeat_words"))


def words_of(text: str):
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def rates(c: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return c.withColumns({"symbol_rate": F.col("n_symbols") / n, "dup_line_rate": F.col("n_dup_lines") * 10 / n, "repeat_rate": F.col("n_repeat_words") / n, "word_length": F.col("word_chars") / n})


def thresholds(measured: DataFrame, k: int = SKETCH_K, least: int = LEAST_GROUP) -> DataFrame:
    """A row for each language and source: the fence of every rate, from its own
    sketch if that has ``least`` rows, else from its language's."""
    names = list(TAILS)
    own = common.written(measured.groupBy("lang", "source").agg(F.count("*").alias("rows"), *[F.kll_sketch_agg_double(r, F.lit(k)).alias(r) for r in names]), "quality-sketches")
    spoken = own.groupBy(F.col("lang").alias("l")).agg(*[F.kll_merge_agg_double(r, F.lit(k)).alias(f"{r}_all") for r in names])
    both = own.join(spoken, F.col("lang").eqNullSafe(F.col("l")))
    fences = []
    for r, q in TAILS.items():
        sketch = F.when(F.col("rows") >= least, F.col(r)).otherwise(F.col(f"{r}_all"))
        mid, upper, tail = (F.kll_sketch_get_quantile_double(sketch, F.lit(x)) for x in (0.5, 0.75, q))
        fences.append(F.greatest(tail, mid + REACH * (upper - mid)).alias(f"{r}_fence"))
    return both.select("lang", "source", *fences)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and rates with base_failed and kept."""
    measured = rates(common.written(counts(docs, id_col, text_col), "quality-counts"))
    fences = thresholds(measured)
    f = fences.select(F.coalesce("lang", F.lit("")).alias("l"), F.col("lang").isNull().alias("nl"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("ns"), *[f"{r}_fence" for r in TAILS])
    m = measured.withColumns({"l": F.coalesce("lang", F.lit("")), "nl": F.col("lang").isNull(), "s": F.coalesce("source", F.lit("")), "ns": F.col("source").isNull()})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    n, within = F.greatest(F.col("n_words"), F.lit(1)), F.lit(True)
    sure = lambda c: F.col(c) - NOISE * F.sqrt(F.col(c).cast("double"))
    least = {"symbol_rate": sure("n_symbols") / n, "dup_line_rate": sure("n_dup_lines") * 10 / n, "repeat_rate": sure("n_repeat_words") / n, "word_length": F.col("word_length")}
    for r in TAILS:
        within = within & (least[r] <= F.col(f"{r}_fence"))
    return m.join(f, ["l", "nl", "s", "ns"]).drop("l", "nl", "s", "ns").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(common.table(spark, sf_dir, "documents")).select("doc_id", *names)
