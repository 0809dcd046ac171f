"""Segmentation of unspaced text against brute force and a language that is known."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import bm25, segment


def every(run):
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        out, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(run[start:i])
                start = i
        yield out + [run[start:]]


def test_the_best_path_by_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        words = {"".join(rng.choice("天地人") for _ in range(rng.randrange(1, 5))): math.log(rng.random()) for _ in range(8)}
        lex = segment.Lexicon(words, max(map(len, words)), -9.0)
        run = "".join(rng.choice("天地人") for _ in range(rng.randrange(1, 9)))
        cost = lambda ws: sum(words.get(w, -9.0 if len(w) == 1 else -math.inf) for w in ws)  # noqa: B023, E731
        got = segment.best_path(run, lex)
        assert "".join(got) == run and cost(got) == pytest.approx(max(map(cost, every(run))))
    assert segment.best_path("", segment.Lexicon({}, 1, -1.0)) == []


@pytest.mark.parametrize("dense, places", [(1 << 22, 1 << 18), (0, 1), (1 << 22, 7)])
def test_many_runs_at_once_as_one_by_one(monkeypatch, dense, places):
    monkeypatch.setattr(segment, "DENSE", dense)
    monkeypatch.setattr(segment, "PLACES", places)
    rng = random.Random(4)
    for _ in range(60):
        words = {"".join(rng.choice("天地人𝄞") for _ in range(rng.randrange(1, 6))): rng.choice([-1.0, -2.0, -3.0, math.log(rng.random())]) for _ in range(rng.randrange(12))}
        lex = segment.Lexicon(words, max(map(len, words), default=1), -9.0)
        runs = ["".join(rng.choice("天地人𝄞x") for _ in range(rng.randrange(14))) for _ in range(20)]
        times, want = [rng.randrange(1, 9) for _ in runs], {}
        for r, n in zip(runs, times, strict=True):
            for w in segment.best_path(r, lex):
                want[w] = want.get(w, 0) + n
        lattice = segment.Lattice(lex)
        for half in (slice(0, 9), slice(9, 20)):
            lattice.count(segment._letters(pa.array(runs[half])), np.array([len(r) for r in runs[half]]), np.array(times[half]))
        assert lattice.counted() == want
        rows = [[{"p": r or "-", "run": bool(r) and rng.random() < 0.6} for r in rng.sample(runs, rng.randrange(5))] for _ in range(6)]
        column = pa.array([[]] + rows, pa.list_(pa.struct([("p", pa.string()), ("run", pa.bool_())]))).slice(1)
        assert lattice.spaced(column) == ["".join(f" {' '.join(segment.best_path(x['p'], lex))} " if x["run"] else x["p"] for x in row) for row in rows]


def language(rng, n):
    letters = [chr(0x4E00 + i) for i in range(300)]
    words = list({"".join(rng.sample(letters, rng.choice([1, 2, 2, 2, 3]))) for _ in range(n)})
    return words, [1 / (i + 3) for i in range(len(words))]


def test_counts_and_words_of_a_known_language(spark):
    rng = random.Random(2)
    words, weights = language(rng, 250)
    true = [rng.choices(words, weights, k=rng.randrange(3, 12)) for _ in range(3000)]
    texts = spark.createDataFrame([("。".join("".join(s) for s in true[i : i + 3]),) for i in range(0, 3000, 3)] + [(None,), ("",), ("latin only",)], "text string")
    found = segment.runs(texts)
    assert found.agg(F.sum("n")).first()[0] == 3000
    grams = {r.gram: r.n for r in segment.ngrams(found, 3, 4).collect()}
    want = {}
    for s in true:
        e = segment.EDGE + "".join(s) + segment.EDGE
        for i in range(len(e)):
            for k in range(1, 5):
                if i + k <= len(e):
                    want[e[i : i + k]] = want.get(e[i : i + k], 0) + 1
    assert grams == {g: n for g, n in want.items() if n >= 4 or len(g) == 1}
    lex = segment.learn(texts)
    right = made = wanted = 0
    for s in true[:600]:
        ends = lambda ws: set(itertools.accumulate(map(len, ws)))
        a, b = ends(segment.best_path("".join(s), lex)), ends(s)
        right, made, wanted = right + len(a & b), made + len(a), wanted + len(b)
    assert right / made > 0.9 and right / wanted > 0.9


def test_candidates_by_definition(spark):
    rng = random.Random(3)
    runs = ["".join(rng.choice("一二三四") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    grams = segment.ngrams(segment.runs(spark.createDataFrame([(r,) for r in runs], "text string")), 3, 3)
    got = {r.gram: r.n for r in segment.candidates(grams, 3, -0.2, 1.0).collect()}
    count = {r.gram: r.n for r in grams.collect()}
    letters = sum(n for g, n in count.items() if len(g) == 1 and g != segment.EDGE)

    def entropy(ns, total):
        return math.log(total) - sum(n * math.log(n) for n in ns) / total

    want = {}
    for g, n in count.items():
        if 2 <= len(g) <= 3 and segment.EDGE not in g:
            sides = [[m for x, m in count.items() if len(x) == len(g) + 1 and (x[:-1] if s else x[1:]) == g] for s in (0, 1)]
            pmi = min(math.log(n * letters / (count[g[:k]] * count[g[k:]])) for k in range(1, len(g)))
            if min(entropy(s, n) for s in sides) >= 1.0 and pmi >= -0.2:
                want[g] = n
    assert got == want and want


def test_spaced_text_is_found_by_its_words(spark):
    lex = segment.Lexicon({"检索": -1.0, "系统": -1.0, "优化": -1.0}, 2, -9.0)
    rows = spark.createDataFrame([(1, "RAG检索系统v2, 优化!"), (2, "no run"), (3, None), (4, ""), (5, "系统")], "chunk_id long, content string")
    got = {r.chunk_id: (r.content, r.w) for r in segment.spaced(rows, "content", lex).withColumn("w", T.tokenize(F.col("content"))).collect()}
    assert got[1][1] == ["RAG", "检索", "系统", "v2", "优化"] and got[1][0].replace(" ", "") == "RAG检索系统v2,优化!"
    assert [got[i][0] for i in (2, 3, 4)] == ["no run", None, ""] and got[5][1] == ["系统"]
    queries = segment.spaced(spark.createDataFrame([(1, "优化检索")], "query_id long, query string"), "query", lex)
    found = bm25.search(queries, segment.spaced(rows, "content", lex)).collect()
    assert [r.chunk_id for r in found] == [1]
    assert not bm25.search(spark.createDataFrame([(1, "优化检索")], "query_id long, query string"), rows).collect()
