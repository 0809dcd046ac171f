"""Secret scans in DataFrame operations only: fixed patterns, and a battery of
randomness tests over other long tokens.

Positions come from splitting a text at a pattern's matches: the lengths of the
pieces and the matches, added up, give every start, in code points. Tokens that
no base span touches, mix digits and letters and fit an encoding (hex, base32,
base36, base64) are tested for randomness in that encoding's alphabet: a
chi-squared test of uniform cells, a runs test about the alphabet's middle and a
lag-1 serial correlation test. Fisher's method combines the three. A short token
hardly ever fails such tests, a long one of ordinary text nearly always does, so
false discoveries are controlled by length: within each length class (powers of
two) a Benjamini-Hochberg step-up at ``FDR`` decides which tokens are found not
random; the rest are added as ``random`` spans. The step-up reads a bounded
histogram of p-values, not the candidates.

Defined results: null and empty texts have no spans; texts are scanned whole, a row's
memory being a few times its text and its tokens; null and repeated ids are separate
rows; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base patterns, in the order that ranks spans of one start.
#: Runs too short to count never match a longer run's pattern, so the lengths of
#: ``access`` and ``hex`` stand in the patterns; that of ``assign`` may not, as
#: its failing matches still use up their text.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
VALUE_CHARS = 6
FDR = 0.05
#: encoding: pattern, alphabet (in value order), cells of equal probability
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 16),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
    "base36": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 12),
    "base64": (r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 16),
}
BINS_PER_DECADE = 16
MOST_DECADES = 12
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _total(a):
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _before(lens):
    """Sums of all earlier entries, in two levels of the square root's size."""

    def levels(a):
        b = F.greatest(F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int"), F.lit(1))

        def chunks(step):
            sums = F.transform(F.sequence(F.lit(0), step - 1), lambda c: _total(F.slice(a, c * step + 1, step)))

            def places(s):
                tops = F.transform(F.sequence(F.lit(0), step - 1), lambda c: _total(F.slice(s, F.lit(1), c)))

                def each(t):
                    return F.transform(a, lambda _, i: F.get(t, (i / step).cast("int")) + _total(F.slice(a, (i / step).cast("int") * step + 1, i % step)))

                return common.let(tops, each)

            return common.let(sums, places)

        return common.let(b, chunks)

    return F.when(F.size(lens) > 0, common.let(lens, levels)).otherwise(F.array().cast("array<int>"))


def spans(text, pattern: str, kind: str, group: int | None = None, least: int = 0):
    """The leftmost non-overlapping matches as (start, kind, end, value); if
    group is given, those whose group has at least so many characters."""
    p = F.lit(pattern)

    def build(found):
        step = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("own")))

        def placed(s):
            lens = F.transform(s, lambda x: x["gap"] + x["own"])

            def rows(before):
                start = lambda i: F.get(before, i) + F.get(s, i)["gap"]
                out = F.transform(found, lambda m, i: F.struct(start(i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start(i) + F.length(m)).alias("end"), m.alias("value")))
                if group is None:
                    return out
                inner = F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length)
                return common.let(inner, lambda n: F.filter(out, lambda _, i: F.get(n, i) >= least))

            return common.let(_before(lens), rows)

        return common.let(step, placed)

    return F.when(text.rlike(pattern), common.let(F.regexp_extract_all(text, p, F.lit(0)), build)).otherwise(F.array().cast(SPAN))


def _upper(z):
    """Upper tail of the normal distribution, to about 1e-4."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), 1.5976 * z + 0.07056 * z * z * z))))


def p_random(token):
    """Fisher's combination of the three tests; null if the token fits no
    encoding or doesn't mix digits and letters. Near 0: not random."""

    def tests(x, size: int, cells: int):
        n = F.size(x).cast("double")

        def in_cell(c: int):
            return lambda v: F.floor(v * cells / size) == c

        def measured(mean):
            squares = F.lit(0.0)
            for c in range(cells):
                k = F.size(F.filter(x, in_cell(c)))
                squares = squares + k * k
            chi = (squares * cells / n - n) / (cells - 1)
            v = 2.0 / (9 * (cells - 1))
            p_cells = _upper((F.pow(chi, 1 / 3) - (1 - v)) / v**0.5)
            high = F.transform(x, lambda e: (e >= size / 2).cast("int"))

            def run_test(h):
                a = _total(h).cast("double")
                mu = 2 * a * (n - a) / n + 1
                runs = 1 + _total(F.transform(h, lambda e, i: F.when(i > 0, (e != F.get(h, i - 1)).cast("int")).otherwise(0)))
                var = (mu - 1) * (mu - 2) / (n - 1)
                return F.when(var > 0, 2 * _upper(F.abs(runs - mu) / F.sqrt(var))).otherwise(0.0)

            dev = F.transform(x, lambda e: e - mean)

            def serial(d):
                add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e)
                power = add(F.transform(d, lambda e: e * e))
                near = add(F.transform(d, lambda e, i: F.when(i > 0, e * F.get(d, i - 1)).otherwise(0.0)))
                return F.when(power > 0, 2 * _upper(F.abs(near / power + 1 / n) * F.sqrt(n))).otherwise(0.0)

            logs = F.lit(0.0)
            for p in (p_cells, common.let(high, run_test), common.let(dev, serial)):
                logs = logs - F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)))
            return common.let(logs, lambda h: F.exp(-h) * (1 + h + h * h / 2))

        return common.let(_total(x) / n, measured)

    def under(name: str):
        _, alphabet, cells = ENCODINGS[name]
        text = F.lower(token) if name in ("hex", "base36") else F.translate(token, "-_=", "+/")
        values = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
        return common.let(values, lambda x: tests(x, len(alphabet), cells))

    out = F.lit(None).cast("double")
    for name, (pattern, _, _) in reversed(ENCODINGS.items()):
        out = F.when(token.rlike(pattern), under(name)).otherwise(out)
    return F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), out)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, more): base spans, sorted, and tested tokens outside them."""
    t = F.col("t")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    base = F.array_sort(F.concat(spans(t, ASSIGN, "assign", 1, VALUE_CHARS), spans(t, ACCESS, "access"), spans(t, HEX, "hex")))
    rows = rows.select("doc_id", base.alias("base"), spans(t, TOKEN, "random").alias("c"))
    apart = F.filter("c", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    tested = F.transform(apart, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.floor(F.log2(F.length(x["value"]).cast("double"))).cast("int").alias("class"), p_random(x["value"]).alias("p")))
    more = F.filter(tested, lambda x: x["p"].isNotNull())
    slim = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    return rows.select("doc_id", slim.alias("base"), F.when(F.size("c") > 0, more).otherwise(F.array().cast("array<struct<start:int,end:int,class:int,p:double>>")).alias("more"))


def limits(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """(class, limit): p-values up to the limit are found not random."""
    steps = BINS_PER_DECADE * MOST_DECADES
    each = tested.select(F.explode("more").alias("x")).select(F.col("x.class").alias("class"), F.least(F.lit(steps), F.floor(-F.log10(F.greatest(F.col("x.p"), F.lit(1e-300))) * BINS_PER_DECADE)).cast("int").alias("bin"))
    hist = each.groupBy("class", "bin").agg(F.count("*").alias("n"))
    # a bin's p-values are at most its upper end
    ranked = hist.selectExpr("class", "bin", "sum(n) over (partition by class order by bin desc) as rank", "sum(n) over (partition by class) as m", f"power(10.0D, -bin / {BINS_PER_DECADE}.0D) as top")
    return ranked.filter(F.col("top") <= fdr * F.col("rank") / F.col("m")).groupBy("class").agg(F.max("top").alias("limit"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, base, random): base spans, and those that the tests add."""
    tested = common.written(scanned(docs, id_col, text_col), "secret-spans")
    by_class = limits(tested, fdr).agg(F.map_from_entries(F.collect_list(F.struct("class", "limit"))).alias("limits"))  # a few length classes
    kept = F.filter("more", lambda x: x["p"] > F.coalesce(F.element_at("limits", x["class"]), F.lit(0.0)))
    return tested.crossJoin(F.broadcast(by_class)).select("doc_id", "base", F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end"))).alias("random"))


def _text(a):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", count(0), count(1), count(2), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "random"))).alias("spans"))
