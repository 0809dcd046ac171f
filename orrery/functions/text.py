"""Text scalars as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params

#: Words that never are entities, and punctuation cut off entities.
STOP_WORDS = (
    "的 了 是 在 和 与 或 不 也 都 就 要 会 可以 能够 这个 那个 一个 一种 其中 使用 进行 通过 以及 用于 对于 基于 利用 此外 同时 因此 所以 但是 然而 虽然 如果 基本 说 来 去 做 让 把 被 从 到 等 该 并 而 且 所 上 下 中 内"
).split()
MARKS = "，。！？、；：'"
BRACKETS = "（）()【】"
TOKEN = r"[\p{L}\p{N}]+"
COUNTED = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SENTENCE_END = r"(?<=[。！？.!?])\s+"
NUMERIC = r"^[\d.+\-\s]+$"
QUERY_VERSION = r"(?iU)\b(v?\d+(?:\.\d+)*)\b"
BUILD_VERSION = r"(?iU)\b(v?\d+(?:\.\d+)*(?:[-_]?\w+)?)\b"


def tokenize(text: Column) -> Column:
    """Letter and digit runs, their case kept; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def counted(words: Column) -> Column:
    """array<struct<word, n>> of an array's distinct words: runs of the sorted array."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def runs(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(firsts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n"))))

    return F.when(F.size(words) > 0, let(F.array_sort(words), runs)).otherwise(F.array().cast("array<struct<word:string,n:bigint>>"))


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(COUNTED)), F.lit(0)).cast("int")


def split_sentences(text: Column) -> Column:
    """Pieces that end in a terminator followed by white space, trimmed, none empty."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def chunk_id(source: Column, index: Column) -> Column:
    return F.substring(F.md5(F.concat(source, F.lit(":"), index.cast("string"))), 1, 8)


def truncate_text(text: Column, n: int = params.PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, n)


def _first_upper(text: Column) -> Column:
    return F.when(F.substring(text, 1, 1).rlike("^[a-z]$"), F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))).otherwise(text)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_entity_graph(text: Column) -> Column:
    t = F.regexp_replace(_stripped(text), f"[{MARKS}]+$", "")
    return _first_upper(F.regexp_replace(t, f"^[{MARKS}]+", ""))


def normalize_entity_kg_query(text: Column) -> Column:
    t = F.regexp_replace(_stripped(text), r"(?U)\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, f"^[{MARKS}{BRACKETS}]+", ""), f"[{MARKS}{BRACKETS}]+$", "")
    t = F.regexp_replace(t, QUERY_VERSION, "")
    return _first_upper(F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^[ _-]+|[ _-]+$", ""))


def normalize_entity_kg_build(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(_stripped(text), r"(?U)\s+", " "), BUILD_VERSION, "")
    return F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^[ _-]+|[ _-]+$", "")


def normalize_triple(triples: Column) -> Column:
    """An array of (subject, relation, object) with both ends normalised."""
    return F.transform(triples, lambda t: F.struct(normalize_entity_kg_build(t["subject"]).alias("subject"), _stripped(t["relation"]).alias("relation"), normalize_entity_kg_build(t["object"]).alias("object")))


def is_valid_entity(text: Column, graph: bool = True) -> Column:
    ok = (F.length(text) >= 2) & ~text.isin(STOP_WORDS) & ~text.rlike("(?U)" + NUMERIC) & ~text.rlike(rf"(?U)^[{MARKS}{BRACKETS}\s]+$")
    if graph:
        ok = ok & ~text.rlike("^#+$")
    return F.coalesce(ok, F.lit(False))


def md_headings(text: Column) -> Column:
    """array<struct<pos int, level int, title string>> of Markdown headings;
    a line's offset is the sum of the lines before it and their breaks."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    with_pos = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,level:int,title:string>>").alias("found")),
        lambda acc, line: F.struct(
            (acc["at"] + F.length(line) + 1).alias("at"),
            F.when(line.rlike(r"^#{1,6}\s+\S"), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("pos"), F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)).cast("int").alias("level"), _stripped(F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1)).alias("title"))))).otherwise(acc["found"]).alias("found"),
        ),
    )
    return with_pos["found"]


def heading_breadcrumb(headings: Column, pos: Column) -> Column:
    """Titles above pos: a heading counts unless a later one up to pos has its
    level or a higher one."""
    upto = F.filter(headings, lambda h: h["pos"] <= pos)
    return F.transform(F.filter(upto, lambda h: ~F.exists(upto, lambda k: (k["pos"] > h["pos"]) & (k["level"] <= h["level"]))), lambda h: h["title"])


def parse_judge_score(raw: Column, shown: int = 100) -> Column:
    """struct<score double, reason string> of a judge's answer: the fenced part
    if there is one, clamped to [0, 1]; 0 and a message if it can't be read."""
    fenced = F.when(raw.contains("```json"), F.regexp_extract(raw, r"(?s)```json(.*?)```", 1)).when(raw.contains("```"), F.regexp_extract(raw, r"(?s)```(.*?)```", 1)).otherwise(raw)
    body = F.trim(F.regexp_replace(fenced, r"^\s+|\s+$", ""))
    # a missing score is 0, one that is no number can't be read
    row = F.from_json(body, "score string, reason string")
    number = F.when(body.rlike(r"^\{"), F.coalesce(row["score"].try_cast("double"), F.when(~body.rlike(r'"score"\s*:') & body.rlike(r"\}$"), F.lit(0.0))))
    return F.struct(F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(0.0).alias("score"), F.when(number.isNotNull(), F.coalesce(row["reason"], F.lit(""))).otherwise(F.concat(F.lit("解析失败: "), F.substring(raw, 1, shown))).alias("reason"))
