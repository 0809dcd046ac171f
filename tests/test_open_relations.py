"""Open relation extraction against a plain version, and into the knowledge graph's search."""

import re
from collections import Counter, defaultdict
from itertools import groupby

from pyspark.sql import functions as F

from orrery import registry, storage
from orrery.operators import kg, open_relations as o

WORD = re.compile(r"[^\W_]+")


def plain(rows, share, support):
    sentences = [(c, src, [w for w in WORD.findall(s)]) for c, src, text in rows for s in re.split(r"(?<=[。！？.!?])\s+", text or "")]
    sentences = [x for x in sentences if x[2]]
    df = Counter(w for _, _, ws in sentences for w in {w.lower() for w in ws})
    args = {w for w, n in df.items() if len(w) >= o.LETTERS and n <= max(1, share * len(sentences)) and not w.isdigit()}
    found = []
    for c, src, ws in sentences:
        runs = [(k, list(g)) for k, g in groupby(ws, key=lambda w: w.lower() in args)]
        for (k, a), (_, r), (_, b) in zip(runs, runs[1:], runs[2:], strict=False):
            if k and len(a) <= o.SPAN and len(r) <= o.PHRASE and len(b) <= o.SPAN and " ".join(a).lower() != " ".join(b).lower():
                found.append((c, src, " ".join(a), " ".join(r).lower(), " ".join(b)))
    said = Counter((r, a.lower(), b.lower()) for _, _, a, r, b in found)
    pairs = defaultdict(int)
    for r, _, _ in said:
        pairs[r] += 1
    out = []
    for c, src, a, r, b in found:
        if pairs[r] >= support:
            n = said[r, a.lower(), b.lower()]
            out.append((c, src, a, r, b, pairs[r], n, round(1 - (1 - pairs[r] / (pairs[r] + support)) ** n, 4)))
    return sorted(out)


def test_the_documents_by_a_plain_version(spark, sf):
    chunks = registry.chunks(spark, sf)
    rows = [(r.chunk_id, r.source, r.content) for r in chunks.collect()]
    got = sorted(tuple(r) for r in o.extracted(chunks).collect())
    want = plain(rows, o.SHARE, o.SUPPORT)
    assert [g[:7] for g in got] == [w[:7] for w in want] and len(got) > 100
    assert all(abs(g[7] - w[7]) < 2e-4 for g, w in zip(got, want, strict=True))


def test_said_triples_are_found_and_searched(spark):
    names = ["Berlin", "Madrid", "Lisbon", "Prague", "Vienna"]
    lands = ["Germany", "Spain", "Portugal", "Czechia", "Austria"]
    texts = [f"{a} is the capital of {b}. It is an old one, and so it is." for a, b in zip(names, lands, strict=True)] + ["Berlin is the capital of Germany.", None, "", "It is so."]
    chunks = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "chunk_id long, source string, content string")
    got = o.extracted(chunks, share=0.2)
    rows = {(r.subject, r.relation, r.object): (r.support, r.evidence, r.confidence) for r in got.collect()}
    assert rows["Berlin", "is the", "capital of Germany"] if ("Berlin", "is the", "capital of Germany") in rows else rows["Berlin", "is the capital of", "Germany"]
    assert len(rows) == 5 and rows["Berlin", "is the capital of", "Germany"] == (5, 2, 0.8594)
    triples = kg.clean_triples(o.records(got))
    asked = spark.createDataFrame([(1, "Spain")], "query_id long, entity string")
    assert [r.chunk_id for r in kg.search(asked, triples, chunks.select("chunk_id", "source")).orderBy("rank").collect()] == [1]
    assert o.extracted(chunks.limit(0)).count() == 0 and o.records(got, 0.99).count() == 0
    assert got.filter(F.col("relation") != F.lower("relation")).isEmpty()


def test_no_word_is_written(spark, monkeypatch):
    """A sentence's runs are found in its own row: tables hold candidates and relations, not words."""
    texts = [f"Quito{i} was built before Lagos{i}. It was so! x{i} 12345 of the Tallinn{i}" for i in range(40)]
    rows = [(i, f"d{i}", t) for i, t in enumerate(texts)]
    held, plainly = {}, storage.written
    monkeypatch.setattr(storage, "written", lambda df, name: held.setdefault(name, plainly(df, name)))
    got = sorted(tuple(r) for r in o.extracted(spark.createDataFrame(rows, "chunk_id long, source string, content string"), 0.05, 3).collect())
    want = plain(rows, 0.05, 3)
    assert [g[:7] for g in got] == [w[:7] for w in want] and len(got) == 40
    assert sum(df.count() for df in held.values()) <= 2 * len(got) and not any("i" in df.columns or "word" in df.columns for df in held.values())
