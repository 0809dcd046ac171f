"""Each operator against brute force, with nulls, ties, repeats and empty tables."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from orrery.llm import common, decontaminate, html, mixing, quality, queries, rans, secrets, simhash, toxicity, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"
ODD = [
    (1, None, None, None, None, "a", "b"),
    (2, "", "en", "s1", 0, None, None),
    (3, "one two three four. " * 40, "en", "s1", 5, "x", "y"),
    (3, "one two three four. " * 40, "en", "s1", 5, "x", "y"),
    (5, "é ß 你好 \U0001f600 \x00 end", "fr", "s2", 9, "x", None),
    (None, "no id here", "en", "s2", 9, "x", None),
    (7, "word " * 20000, "de", "s3", 100000, None, None),
    (8, "the same line\nthe same line\n\n  \nother", None, "s3", 1, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return WORD.findall(t or "")


# ------------------------------------------------------------------- op1


def test_tokenizer_matches_library_on_random_pieces():
    import random

    path, rng = rans.default_tokenizer(), random.Random(3)
    lib, ours = Tokenizer.from_file(path), rans.WordTokenizer(path)
    alphabet = "aAéÉ.,'<|>sT1 \n\tß×你\u0301 \x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["x<|endoftext|>y", "tok<|startoftext|>en <|startoftext|>", "x" * 100 + " " + "y" * 24 + " " + "z" * 25, "İ ΣΣ. Ā.", None, "×. ÷,"]
    for lo in range(0, len(texts), 31):
        part = texts[lo : lo + 31]
        ids, n = ours.encode(part, 2)
        for t, end, k in zip(part, np.cumsum(n), n, strict=True):
            assert list(ids[end - k : end]) == lib.encode(t or "", add_special_tokens=False).ids + [2], t


@pytest.mark.parametrize("n", [1, 2, 127, 128, 5000, 300_000])
def test_rans_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49000).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    table = rans.Table(symbols.astype(np.int64), rans.scaled(symbols.astype(np.int64), counts.astype(np.int64)))
    data = rans.encode_block(ids, np.array([4]), np.array([0]), np.array([n]), table)
    docs, nulls, lengths, back = rans.decode_block(data, table)
    assert (back == ids).all() and docs[0] == 4 and lengths[0] == n and not nulls[0]
    bits, lanes, *_, marks, stream = rans.read_block(data)
    if len(marks) > 1:  # decoding may begin at any checkpoint
        tail = rans.decode_run(table, lanes, n, stream, marks[-1], -(-n // lanes))
        assert (tail == ids[marks[-1][0] * lanes :]).all()
    with pytest.raises(ValueError):
        rans.decode_block(data[:-1] + bytes([data[-1] ^ 1]), table)


def test_op1(spark, odd, empty):
    lib = Tokenizer.from_file(rans.default_tokenizer())
    got = [tuple(r) for r in rans.round_trip(odd).orderBy("start").collect()]
    want, at = [], 0
    for i, t, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert rans.round_trip(empty).collect() == []


# ------------------------------------------------------------------- op2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<article><h1>A &amp; B</h1><p>one<br>two<p>three</article><footer>no</footer>", "A & B one two three"),
        ("<body><nav>menu</nav><div class='ad'>buy</div><main><p>x<script>var a='</p>';</script>y</main><div id=comments>c</div>", "xy"),
        ("<article>A<aside>side</aside><p>B<section class='comments'><p>r</section></article>", "A B"),
        ("<article><p>a &lt;b&gt; &#233; &nbsp; c &am", "a <b> é c &am"),
        ("<p>hello <!-- gone --> there", "hello there"),
        ("<article><p>cut off <script>never closed", "cut off"),
        ("<ul class=menu><li>a<li>b</ul><p>" + "body text " * 20, ("body text " * 20).strip()),
        ("<article><p>" + "long " * 50000 + "</article>", ("long " * 50000).strip()),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_runs():
    assert html.runs([0, 5, 90, 0, 0, 0, 100, 0, 0, 0], surge=80) == [(1, 3), (6, 7)]


def test_op2_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x", 5), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    got = html.extracted(pages).collect()
    assert [tuple(r) for r in got] == [(1, "u", 5, "x"), (None, None, None, "")]


# ------------------------------------------------------------------- op3


def test_op3(spark):
    seen = ["http://a.example.org/en/200", "https://example.org/es/5", "x://EXAMPLE.org/en/17?q", "http://b.com/de/1", "http://b.com/fr/1", "http://org", "http://z.net/es/9", "http://notexample.org/es/1", "nourl", None, "http://x.com/"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(seen)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judged(rows, support=0.2).collect()}
    assert [got[i].rule for i in range(11)] == ["org/", "example.org/es/", "example.org/en/1", "com/de/", "com/fr/", None, None, "org/", None, None, None]
    assert (got[2].host, got[2].path) == ("example.org", "/en/17") and (got[9].host, got[9].path, got[9].verdict) == ("", "", "allow")
    assert urls.judged(rows.limit(0)).count() == 0


def test_rules_by_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [([t for t in "abcd" if rng.random() < 0.6], "block" if rng.random() < 0.5 else "allow") for _ in range(60)]
    data = [(sorted(t), "block" if {"a", "b"} <= set(t) else y) for t, y in data if t]
    rules = urls.mined_rules(spark.createDataFrame(data, "tokens array<string>, label string"), 0.05, 0.8).collect()
    import itertools

    def stat(s, y):
        fits = [lab for t, lab in data if s <= set(t)]
        return fits.count(y), len(fits)

    want = set()
    for n in range(1, 5):
        for s in itertools.combinations("abcd", n):
            for y in ("allow", "block"):
                hits, total = stat(set(s), y)
                if hits >= 0.05 * len(data) and hits / total >= 0.8:
                    parts = [stat(set(s) - {x}, y) for x in s] if n > 1 else []
                    if not any(h >= 0.05 * len(data) and h / t >= 0.8 and h / t >= hits / total for h, t in parts):
                        want.add((s, y, hits))
    assert {(tuple(sorted(r.tokens)), r.verdict, r.support) for r in rules} == want


# ------------------------------------------------------------------- op4


def brute_edit(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distances():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n, most = int(rng.integers(1, 12)), int(rng.integers(0, 4))
        x, y = rng.integers(0, 4, (3, n)), rng.integers(0, 5, 30)
        start = rng.integers(0, 30, 3)
        stop = np.array([rng.integers(s, 31) for s in start])
        got, _ = decontaminate.edit_distances(x, y, start, stop, most)
        for k in range(3):
            want = brute_edit(x[k].tolist(), y[start[k] : stop[k]].tolist())
            assert got[k] == want if want <= most else got[k] > most


def test_op4_against_every_window(spark, odd, empty):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(12, 50))))) for i in range(20)] + [(90, None), (91, ""), (92, "Solo")]
    docs, planted = [], set()
    for d in range(60):
        t = rng.choice(vocab, int(rng.integers(60, 200))).tolist()
        if d % 3 == 0:
            i = int(rng.integers(20))
            x, at = items[i][1].upper().split(), int(rng.integers(len(t)))
            if d % 2 == 0:
                x[int(rng.integers(len(x)))] = "edited"
            t[at:at] = x
            planted.add((d, i))
        docs.append((d, ", ".join(t)))
    docs += [(100, None), (101, ""), (102, "say solo now")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.matches(frame, bench, ["doc_id"]).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in rows}
    assert planted | {(102, 92)} <= set(got)
    for d, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        for i, x in items:
            q = (x or "").lower().split()
            if (d, i) in got:
                assert got[d, i] == min(brute_edit(q, w[s:]) for s in range(len(w))) <= len(q) * decontaminate.MOST_EDITS
    kept = {r.doc_id for r in decontaminate.clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.matches(odd, bench.limit(0), ["doc_id"]).count() == 0 and decontaminate.matches(empty, bench, ["doc_id"]).count() == 0


# ------------------------------------------------------------------- op5


def test_op5(spark, sf, empty):
    docs = common.table(spark, sf, "documents").select("doc_id", "text", "source").unionByName(spark.createDataFrame([(r[0], r[1], r[3]) for r in ODD], "doc_id long, text string, source string"))
    rows, again = mixing.mixed(docs).toPandas(), mixing.mixed(docs.repartition(7)).toPandas()
    order = ["source", "doc_id", "size", "taken"]
    assert rows.sort_values(order)["taken"].tolist() == again.sort_values(order)["taken"].tolist() and len(rows) == docs.count()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[q] for q in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        left -= sum(2.0 * sizes[s] for s in over)
        free = free - set(over) if over else set()
    for s in names:
        own = rows[rows.source.isna()] if s is None else rows[rows.source == s]
        assert own.target.iloc[0] == pytest.approx(target[s]) and abs(own.taken.sum() - target[s]) <= 0.5 + 1e-6
    assert (rows.taken <= 2 * rows["size"]).all()
    full = docs.selectExpr("doc_id", "text", "'en' as lang", "source", "1L as n_chars")
    out = mixing.emitted(full).toPandas()
    assert out.text.map(lambda t: len(words(t))).sum() == rows.taken.sum() and list(out.columns) == full.columns
    assert mixing.mixed(empty).count() == 0 and mixing.emitted(empty.drop("score", "size")).count() == 0


# ------------------------------------------------------------------- op6


def test_word_hashes_are_equal_for_equal_words():
    h, ends = toxicity.word_hashes(["The cat, the CAT!", None, "", "cat"])
    assert ends.tolist() == [4, 4, 4, 5] and h[0] == h[2] and h[1] == h[3] == h[4] and h[0] != h[1]


def test_op6_learns_and_holds_out(spark, odd, empty):
    rng = np.random.default_rng(4)
    bad, vocab = ["vile", "nasty", "awful"], [f"w{i}" for i in range(500)]
    docs, labels = [], []
    for d in range(900):
        t, y = rng.choice(vocab, 60).tolist(), int(d % 5 == 0)
        if y:
            t[10:10] = rng.choice(bad, 3).tolist()
        docs.append((d, " ".join(t)))
        labels.append((d, y))
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(frame, marks, ["doc_id"]).collect()}
    held = [d for d, _ in docs if zlib.crc32(str(d).encode()) % 3 == 1]
    assert {r.order for r in toxicity.sample(frame, marks).collect()} and toxicity.sample(frame, marks).count() == 900 - len(held)
    assert np.mean([(got[d] >= 0.7) == (d % 5 == 0) for d in held]) > 0.95
    flipped = marks.selectExpr("doc_id", "cast(if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as int) as toxic")
    assert {r.doc_id: r.score for r in toxicity.scored(frame, flipped, ["doc_id"]).collect()} == got
    other = toxicity.scored(odd, marks, odd.columns[:5]).collect()
    assert len(other) == len(ODD) and all(0 <= r.score <= 1 for r in other)
    none = toxicity.scored(odd, marks.limit(0), ["doc_id"]).collect()
    assert all(r.score < 1e-6 for r in none) and toxicity.scored(empty, marks, ["doc_id"]).count() == 0


# ------------------------------------------------------------------- op7


def brute_print(t, k=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_trie_pairs():
    rng = np.random.default_rng(5)
    for budget in (0, 1, 2, 4):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(5)]))
        far = np.bitwise_count(a[:, None] ^ a[None])
        i, j = simhash.trie_pairs(a, None, budget)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(int(p), int(q)) for p, q in zip(*np.where(far <= budget), strict=True) if p < q}


@pytest.mark.parametrize("group_rows", [8192, 8, 2])
def test_components_with_split_groups(spark, group_rows):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    a = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(4) for _ in range(3)])).view(np.int64)
    labels = dict(simhash.connected(simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in a], "fp long"), 2, group_rows)).collect())
    i, j = np.where(np.bitwise_count(a.view(np.uint64)[:, None] ^ a.view(np.uint64)[None]) <= 2)
    order = np.argsort(a)
    rank = np.argsort(order)
    root = simhash.forest(len(a), rank[i], rank[j])
    assert all(labels.get(int(a[k]), int(a[k])) == int(a[order][root[rank[k]]]) for k in range(len(a)))


def test_op7(spark, odd, empty):
    more = [(20, "alpha beta gamma delta"), (21, "ALPHA beta\ngamma delta"), (22, " \t"), (23, "two words"), (24, "two words")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in ODD] + more
    prints = [brute_print(t) for _, t in rows]
    got = collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.components(docs).collect())
    want = collections.Counter()
    for (d, _), f in zip(rows, prints, strict=True):
        reach, new = {f}, {f}
        while new:
            new = {g for g in prints if any(bin(g ^ h).count("1") <= 2 for h in reach)} - reach
            reach |= new
        ids = [i for (i, _), g in zip(rows, prints, strict=True) if g in reach and i is not None]
        want[(d, f, min(ids, default=None))] += 1
    assert got == want
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5, 7, 8]
    assert simhash.components(empty).count() == 0 and simhash.keep_first(empty).count() == 0


# ------------------------------------------------------------------- op8


def test_op8(spark, odd, empty, sf):
    docs = odd.unionByName(common.table(spark, sf, "documents").limit(60), allowMissingColumns=True)
    got = collections.defaultdict(list)
    for r in quality.judged(docs).collect():
        got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
        assert not (r.base_failed and r.kept)
    want = collections.defaultdict(list)
    for r in docs.collect():
        t, w = r.text or "", words(r.text)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        want[r.doc_id].append((len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert quality.judged(empty).count() == 0


def test_op8_rejects_the_outliers_of_each_group(spark):
    def text(k, size, symbols):
        return " ".join([f"{i}{'x' * (size - 1 + (i + k) % 2)}"[:size + (i + k) % 2] + "#" * (i < 100 + symbols) for i in range(100, 160)])

    rows = [(k, text(k, 5, 0), "en", "a") for k in range(40)] + [(100, text(0, 9, 0), "en", "a"), (101, text(0, 5, 3), "en", "a")]
    rows += [(200 + k, text(k, 9, 30), "en", "b") for k in range(40)]  # what is odd in a is usual in b
    rows += [(300 + k, text(k, 5 + 2 * k, k), "de", "c") for k in range(5)]  # too few to judge
    kept = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {d for d, k in kept.items() if not k} == {100, 101}


# ------------------------------------------------------------------- op9


def test_spans():
    assert warc.spans([(0, 10), (10, 10), (90, 5), (200, 1)], gap=80, most=100) == [(0, 95, 3), (200, 201, 1)]


def test_op9(spark):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, "same"), (3, "a\r\nb", None), (4, "u4", ""), (7, "u7", "é\r\n\r\nWARC/1.1 x"), (None, "n", "same"), (8, "u8", "only")]
    folder = common.scratch(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r.page_id: r for r in warc.read_records(index, folder, with_payload=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 3: ("response", None), 4: ("revisit", 3), 7: ("response", None), None: ("revisit", 2), 8: ("response", None)}
    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert got[i].record_type == "revisit" or got[i].payload == data
    some = warc.read_records(index.filter("url = 'u7'"), folder).collect()
    assert [r.page_id for r in some] == [7]
    none = common.scratch(spark, "warc-none")
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), none), none).count() == 0


# ------------------------------------------------------------------ op10


def test_op10(spark, odd, empty):
    key = "q7Rk2ZtX9vLm4Wd8sHj3PfBn6YcTg1Ae"
    more = [(20, "Token='abcdef12' x secret: short token=token:abcdef api_key = a.b=c-1"), (21, "AKIA" + "Z" * 16 + " AKIA12 " + "0f" * 12 + "\U0001f600 " + "ab" * 11), (22, "token=abcdef1 " * 300), (23, f"see {key} here and {'a1' * 20} too")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {(r.doc_id, len(r.base)): r for r in secrets.found(docs).collect()}
    for d, t in [(r[0], r[1]) for r in ODD] + more:
        t = t or ""
        want = sorted([(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        assert [(s.start, s.kind, s.end) for s in got[d, len(want)].base] == want
    found = got[23, 1].random if (23, 1) in got else got[23, 0].random
    assert [(s.start, s.end) for s in found] == [(4, 4 + len(key))]
    assert secrets.found(empty).count() == 0


def test_op10_takes_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "token=abcdef1", "a", 2, "x"), (None, None, None, None, None), (1, "token=abcdef1", "b", 3, "y")], "doc_id long, text string, spans string, kind int, base string")
    got = secrets.found(rows).collect()
    assert sorted((r.doc_id or 0, [(s.start, s.end) for s in r.base]) for r in got) == [(0, []), (1, [(0, 13)]), (1, [(0, 13)])]


# -------------------------------------------------------------- registry


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_similar_components(spark, odd, empty):
    import random

    rng, rows = random.Random(1), []
    for k in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((10 * k, " ".join(w)))
        for c in range(1, 4):  # near copies: three words differ, similarity about 0.86
            x = list(w)
            for _ in range(3):
                x[rng.randrange(200)] = f"e{rng.randrange(99)}"
            rows.append((10 * k + c, " ".join(x)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for group_rows in (8192, 3):
        got = {r.doc_id: r.component_id for r in simhash.similar_components(frame, group_rows=group_rows).collect()}
        assert len(got) == len(rows) and all(c % 10 == 0 or got[d] == c for d, c in got.items() if d // 10 == c // 10)
        assert all(c // 10 == d // 10 for d, c in got.items())  # unrelated texts stay apart
        assert sum(c == d // 10 * 10 for d, c in got.items()) >= 0.95 * len(rows)
    assert simhash.similar_components(odd).count() == len(ODD) and simhash.similar_components(empty).count() == 0


def test_similar_components_are_exact(spark):
    rng, rows = np.random.default_rng(4), []
    for k in range(30):
        base = [f"w{x}" for x in rng.integers(0, 9**6, 300)]
        rows.append((10 * k, " ".join(base)))
        for c, share in enumerate((0.06, 0.10, 0.14, 0.17, 0.20), 1):  # another end: similarity 0.89 down to 0.67
            n = int(300 * share)
            rows.append((10 * k + c, " ".join(base[: 300 - n] + [f"v{x}" for x in rng.integers(0, 9**6, n)])))
    rows += [(1000 + k, "again and again and again and again " * 60 + " ".join(f"u{x}" for x in rng.integers(0, 9**6, 60))) for k in range(4)]  # alike in repeats only
    sets = {d: set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        return d if root[d] == d else find(root[d])

    for x in sets:
        for y in sets:
            if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                root[max(find(x), find(y))] = min(find(x), find(y))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_components(frame).collect()}
    assert {d for d in sets if find(d) != d} and all(find(got[d]) == find(d) for d in sets)  # none is tied that must not be
    assert sum(got[d] != find(d) for d in sets) <= 2


@pytest.mark.parametrize(("n", "count"), [(24, 100), (50, 100), (600, 20)])
def test_op4_recall_at_most_edits(n, count):
    rng = np.random.default_rng(n)
    items = [rng.choice(3000, n).tolist() for _ in range(count)]
    docs = []
    for x in items:
        y = list(x)
        for _ in range(int(n * decontaminate.MOST_EDITS)):
            at, kind = int(rng.integers(len(y))), int(rng.integers(3))
            y[at : at + (kind != 1)] = [int(rng.integers(4000))] if kind != 2 else []
        docs.append(rng.integers(0, 4000, 20).tolist() + y + rng.integers(0, 4000, 20).tolist())
    text = lambda t: " ".join(f"w{v}" for v in t)
    doc, item, *_ = decontaminate.Index(list(range(count)), [text(x) for x in items]).search([text(d) for d in docs])
    assert all(brute_edit(items[k], docs[k][20:]) <= n * decontaminate.MOST_EDITS for k in range(3))
    assert sum(d == i for d, i in zip(doc.tolist(), item.tolist(), strict=True)) >= 0.9 * count


def test_main_text_without_article_goes_on_behind_an_advert():
    body, close = "long text of the body. " * 180, "closing words. " * 30
    page = f"<body><nav>menu</nav><h1>Title</h1><div class=share>share</div><p>{body}</p><div class=ad>buy</div><p>See</p><div class=ad>buy</div><p>{close}</p><footer>no</footer>"
    assert html.main_text(page) == " ".join(f"Title {body} See {close}".split())


def test_op3_mines_all_labelled_rows(spark):
    from pyspark.sql import functions as F

    host = F.concat(F.lit("http://h"), (F.col("id") % 40).cast("string"), F.lit(".net/p"))
    label = F.when(F.col("id") % 2 == 1, "block").otherwise("allow")
    pages = spark.range(40).select(F.col("id").alias("page_id"), host.alias("url"))
    got = urls.judged(pages, labels=spark.range(600_000).select(host.alias("url"), label.alias("label"))).collect()
    assert all(r.by == "mined" and r.verdict == ("block" if r.page_id % 2 else "allow") for r in got) and len(got) == 40


def test_keep_first_loses_no_text_and_keeps_one_of_equal_rows(spark):
    a, b = "one two three four five six seven eight nine ten", "quite another text with other words in each of its places here"
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "w"), (2, a, "y"), (3, b, "z"), (4, "alone at last", "q"), (4, "alone at last", "q"), (None, a, "n"), (None, "no id and no like in all of this table", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for found in (simhash.components(frame), simhash.similar_components(frame)):
        kept = sorted((r.doc_id or 0, r.text, r.source) for r in simhash.keep_first(frame, found).collect())
        assert [k[:2] for k in kept] == sorted([(0, rows[8][1]), (1, a), (1, b), (4, "alone at last")])
        again = sorted((r.doc_id or 0, r.text, r.source) for r in simhash.keep_first(frame.repartition(5), found).collect())
        assert again == kept


@pytest.mark.parametrize("words", [40, 400])
def test_near_copies_of_one_text_link_as_pairs_do(spark, words):
    """A large group with outliers: parts, marks and the rest of the pairs."""
    import random

    rng = random.Random(words)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for d in range(120):
        x = list(base)
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2)) * words // 100 + rng.choice((0, 0, 1))):
            x[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(x)))
    sets = {d: set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        return d if root[d] == d else find(root[d])

    for x in sets:
        for y in sets:
            if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                root[max(find(x), find(y))] = min(find(x), find(y))
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=50).collect()}
    assert 1 < len({find(d) for d in sets}) < 100
    assert all(find(got[d]) == find(d) for d in sets) and sum(got[d] != find(d) for d in sets) <= 3


def test_op8_moves_with_the_distribution_and_small_groups_with_their_language(spark):
    def text(k, size, symbols):
        return " ".join([f"{i}{'x' * (size - 3 + (i + k) % 2)}" for i in range(100, 160)]) + " " + "#" * symbols

    def kept(usual, odd):
        rows = [(k, text(k, usual, 0), "en", "a") for k in range(40)] + [(100, text(0, odd, 0), "en", "a"), (101, text(0, usual, 1), "en", "a"), (102, text(0, odd, 0), "en", "tiny"), (103, text(1, usual, 0), "en", "tiny"), (104, text(1, odd, 0), None, "tiny")]
        return {r.doc_id for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if r.kept}

    assert {100, 102} & kept(5, 11) == set() and {101, 103, 104} <= kept(5, 11)  # a single symbol is noise
    assert {100, 101, 102, 103, 104} <= kept(11, 11)  # the same texts where they are usual
