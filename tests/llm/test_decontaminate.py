"""Long items by pieces, bounded indexes, recall over the accepted range."""

import pickle
import time

import numpy as np
import pytest

from orrery.llm import decontaminate as d


def brute_window(x, y):
    """The least edits between x and any window of y."""
    row = [0] * (len(y) + 1)
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, x, share, vocab):
    y = list(x)
    for _ in range(int(len(x) * share)):
        at, kind = int(rng.integers(len(y))), int(rng.integers(3))
        y[at : at + (kind != 1)] = [int(rng.integers(vocab))] if kind != 2 else []
    return y


def text(t):
    return " ".join(f"w{v}" for v in t)


def test_free_alignment_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 4, int(rng.integers(3, 14)))
        y = rng.integers(0, 4, int(rng.integers(0, 40)))
        most, start = int(rng.integers(0, 4)), int(rng.integers(-3, 40))
        got = d.free_alignment(x, y, start, 60, most)  # a band that holds all starts
        want = brute_window(x.tolist(), y.tolist())
        assert (got is None) == (want > most)
        if got:
            begin, n, edits = got
            assert edits == want and brute_window(x.tolist(), y[begin : begin + n].tolist()) == want


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.15, 0.2])
@pytest.mark.parametrize("n", [8, 15, 40, 63, 64, 200, 2000])
def test_recall_over_the_accepted_range(n, share):
    rng = np.random.default_rng([n, int(share * 100)])
    count = 60 if n < 300 else 6
    items = [rng.integers(0, 3000, n).tolist() for _ in range(count)]
    docs = [rng.integers(0, 4000, 25).tolist() + edited(rng, x, share, 4000) + rng.integers(0, 4000, 25).tolist() for x in items]
    doc, item, start, length, edits = d.Index(list(range(count)), [text(x) for x in items]).search([text(y) for y in docs])
    assert (edits <= d.MOST_EDITS * n).all()
    found = {int(a) for a, b in zip(doc, item, strict=True) if a == b}
    assert len(found) >= 0.9 * count
    for k in range(min(5, len(doc))):
        window = docs[doc[k]][start[k] : start[k] + length[k]]
        if n < 300:
            assert brute_window(items[item[k]], window) == edits[k]
            if n > d.PIECE:
                assert edits[k] == brute_window(items[item[k]], docs[doc[k]])


def test_parts_of_an_item_are_no_match():
    rng = np.random.default_rng(3)
    item = rng.integers(0, 3000, 300).tolist()
    doc, *_ = d.Index([1], [text(item)]).search([text(item[:150]), text(item[:100] + rng.integers(3000, 6000, 100).tolist() + item[200:])])
    assert len(doc) == 0


def test_very_long_items_take_seconds_and_little_memory():
    rng = np.random.default_rng(4)
    item = rng.integers(0, 8000, 20_000).tolist()
    began = time.time()
    index = d.Index([1], [text(item)])
    assert len(pickle.dumps(index)) < 30 << 20
    doc, _, start, length, edits = index.search([text(rng.integers(0, 9000, 3000).tolist()), text([1] * 50 + edited(rng, item, 0.1, 8000))])
    assert doc.tolist() == [1] and abs(int(start[0]) - 50) < 3 and edits[0] <= 2000 and time.time() - began < 60


def test_slabs_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items = [(i, text(rng.integers(0, 500, 20))) for i in range(30)] + [(7, "w1 w2 w3")]
    docs = [(i, "x " + items[i][1] + " y", "e", 1) for i in range(30)] + [(50, None, "e", 1), (51, "w1 w2 w3", "e", 1)] * 2
    frame = spark.createDataFrame(docs, "doc_id long, text string, edits string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, i) for i in range(30)) + [(51, 7)] * 2
    names = ["doc_id", "edits", "item_id"]
    one = d.matches(frame, bench, names)
    assert one.columns[:3] == ["doc_id", "doc_edits", "doc_item_id"]
    assert sorted((r.doc_id, r.item_id) for r in one.collect()) == want
    monkeypatch.setattr(d, "SLAB_WORDS", 100)
    assert sorted((r.doc_id, r.item_id) for r in d.matches(frame, bench, names).collect()) == want
    kept = d.clean(frame, bench, least_words=d.LEAST_WORDS)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [50, 50, 51, 51]


def test_short_items_match_whole_lines(spark):
    """Items below LEAST_WORDS words, by brute force over all runs of lines."""
    rng = np.random.default_rng(6)
    items = [(1, "w1"), (2, "W1 w2"), (3, "w2\nw3 w1"), (4, "w1 w2 w3 w4"), (5, "w3, w3."), (6, " \n"), (7, None), (8, "w1 w2 w3 w4 w5 w6 w7 w8"), (9, "w1 w2")]
    texts = ["\n".join(" ".join(f"w{v}" for v in rng.integers(1, 5, int(rng.integers(0, 4)))) for _ in range(int(rng.integers(0, 9)))) for _ in range(200)]
    texts += [None, "", "\n\n", "w1", "a w1 w2 here", "w1\n\nw2", "x\nw1 w2 w3\nw4\ny", "x " * 50_000 + "\nw1 w2\n" + "y " * 50_000, "w1\r\nw2\r\n", "w1 w2 w3 w4 w5 w6 w7 w9"]

    def words(t):
        return (t or "").lower().replace(",", " ").replace(".", " ").split()

    want = set()
    for k, t in enumerate(texts):
        lines = [w for w in map(words, (t or "").split("\n")) if w]
        for i, item in items:
            if 0 < len(words(item)) < d.LEAST_WORDS:
                places = [sum(map(len, lines[:a])) for a in range(len(lines)) for b in range(a + 1, min(len(lines), a + 4) + 1) if sum(lines[a:b], []) == words(item)]
                if places:
                    want.add((k, i, places[0], len(words(item)), 0))
    want.add((len(texts) - 1, 8, 0, 7, 1))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = d.matches(frame, bench, ["doc_id"], least_words=d.LEAST_WORDS, short_lines=True).collect()
    assert {(r.doc_id, r.item_id, r.start_word, r.n_words, r.edits) for r in rows if r.item_id != 8 or r.doc_id == len(texts) - 1} == want and len({r.item_id for r in rows}) >= 5
    hit = {r.doc_id for r in rows}
    kept = d.clean(frame, bench, least_words=d.LEAST_WORDS, short_lines=True)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - hit
    assert {200, 201, 202, 204} <= set(range(len(texts))) - hit
    # without short_lines, as before
    assert {r.item_id for r in d.matches(frame, bench, ["doc_id"], least_words=d.LEAST_WORDS).collect()} <= {8}
