"""FTRL against a plain one, feature sets against a plain walk, odd inputs."""

import math
import zlib

import numpy as np

from orrery.llm import toxicity


def plain_ftrl(own, labels, alpha, beta, l1, l2, epochs):
    z, n, bias_n = {}, {}, 1.0
    share = sum(labels) / len(labels)
    bias = math.log((share + 1e-6) / (1 - share + 1e-6))

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for x, y in zip(own, labels, strict=True):
            w = {int(i): weight(int(i)) for i in x}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()) + bias)))) - y
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
            if abs(g) < 1e-4:
                continue
            for i, wi in w.items():
                more = n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(more) - math.sqrt(n.get(i, 0.0))) / alpha * wi
                n[i] = more
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_by_brute_force():
    rng = np.random.default_rng(1)
    own = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(200)]
    labels = np.array([float(3 in x or 5 in x) for x in own])
    dense, bias = toxicity.train(own, labels, alpha=1.0, l1=0.5, l2=0.2, epochs=3, least=1)
    want, want_bias = plain_ftrl(own, labels, 1.0, toxicity.BETA, 0.5, 0.2, 3)
    got = {int(i): dense[i] for i in np.flatnonzero(dense)}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in got) and math.isclose(bias, want_bias, rel_tol=1e-6)
    assert 3 in got and 5 in got and len(got) < 40


def test_feature_sets_are_words_pairs_and_skip_pairs():
    a, b, c = toxicity.sets(["one two three four", "four one two three", "one"])
    assert len(a) == 4 + 3 + 2 and len(c) == 1 and set(c) < set(a)
    assert len(set(a) & set(b)) == 4 + 2 + 1  # the words, both pairs and the skip-pair of "one two three"
    assert [len(x) for x in toxicity.sets(["", None, "...", "a A a"])] == [0, 0, 0, 3]


def test_scores_are_the_sums_of_a_sets_weights():
    rng, texts = np.random.default_rng(2), ["a b c a b", "", None, "c d " * 50, "z"]
    dense = rng.normal(size=1 << toxicity.HASH_BITS)
    want = [1 / (1 + math.exp(-max(-30, min(30, dense[x].sum() + 0.3)))) for x in toxicity.sets(texts)]
    assert np.allclose(toxicity.scores(texts, dense, 0.3), want)


def test_repeated_ids_and_clashing_names(spark, monkeypatch):
    docs = [(d, f"{'vile' if d % 4 == 0 else 'fine'} w{d % 9} words", 7.0) for d in range(300)] + [(2, "vile vile vile", 7.0)] * 50
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    marks = spark.createDataFrame([(d, int(d % 4 == 0)) for d in range(300)] + [(2, 0), (None, 1)], "doc_id long, toxic int")
    known = [d for d in range(300) if zlib.crc32(str(d).encode()) % 3 != 1]
    rows = toxicity.sample(frame, marks).collect()
    assert len(rows) == len({r.order for r in rows}) == len(known)
    got = toxicity.scored(frame, marks, frame.columns)
    assert got.columns == ["doc_id", "text", "score"] and all(0 <= r.score <= 1 for r in got.collect()) and got.count() == len(docs)
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 10)  # the bound ends the sample, not the run
    at, _, bias = toxicity.model(frame, marks)
    assert len(at) == 0 and math.isfinite(bias)
