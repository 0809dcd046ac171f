"""Main text of pages: the window sums decide, on every page and in linear time."""

import time

import pytest

from orrery.llm import html

ARTICLE = "<body><nav>menu</nav><article><h1>Head</h1><p>%s</p></article><footer>no</footer>" % ("words of the text " * 20)
PLAIN = "<body><nav>menu</nav><h1>Head</h1><p>%s</p><footer>no</footer>" % ("words of the text " * 20)


def brute_runs(lengths, window, surge):
    """Lines from each rise of the window's sum above zero to its fall, looked at one by one."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))] + [0]
    out, i = [], 0
    while i < len(lengths):
        if lengths[i]:
            j = i
            while sums[j]:
                j += 1
            if max(sums[i:j]) >= surge:
                out.append((i, j))
            i = j
        else:
            i += 1
    return out


def test_runs_by_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.choice((0, 0, 0, 5, 40, 200)) for _ in range(rng.randrange(30))]
        for window, surge in ((1, 1), (3, 80), (4, 230)):
            assert html.runs(lengths, window, surge) == brute_runs(lengths, window, surge)


@pytest.mark.parametrize("page", [ARTICLE, PLAIN])
def test_the_sums_pick_the_text(page, monkeypatch):
    assert html.main_text(page) == "Head " + ("words of the text " * 20).strip()
    monkeypatch.setattr(html, "runs", lambda lengths, surge: [])
    assert html.main_text(page) == ""
    monkeypatch.setattr(html, "runs", lambda lengths, surge: [(len(lengths) - 1, len(lengths))])
    assert "words of" not in html.main_text(page) or page == ARTICLE


def test_a_short_block_apart_does_not_surge():
    page = "<body><p>Home of us</p><nav>menu</nav><p>%s</p><nav>menu</nav><p>Bye</p>" % ("body text " * 30)
    assert html.main_text(page) == ("body text " * 30).strip()


def test_short_articles_and_parts_behind_furniture_stay():
    assert html.main_text("<article><p>Hi.<p>Be.</article>") == "Hi. Be."
    page = "<article><p>%s</p><div class='ad'>buy</div><aside>more</aside><p>The end.</p></article>" % ("body text " * 30)
    assert html.main_text(page) == ("body text " * 30) + "The end."


@pytest.mark.parametrize(("name", "kept"), [("related-work", True), ("social-science", True), ("menu-of-the-day text", True), ("side", False), ("related-posts", False), ("ad-slot", False), ("comments", False), ("social share", False)])
def test_names_of_furniture(name, kept):
    text = "real text " * 30
    assert (html.main_text(f"<article><p>first</p><div class='{name}'><p>{text}</div></article>") != "first") == kept


@pytest.mark.parametrize("page", ["</b>" * 40000 + "x", "<b>" * 40000 + "x", "<head>" * 20000 + "x", "<p><b>" * 20000 + "x", "<div>" * 40000 + "x", '<a "' * 20000, "<!--" * 20000])
def test_odd_pages_take_linear_time(page):
    began = time.time()
    assert html.main_text(page) in ("x", "")
    assert time.time() - began < 2


def test_repeats_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, "")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html.extracted(pages).collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert html.extracted(pages.limit(0)).count() == 0


LONG = "words of the text " * 20


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><nav>m</nav><p>{LONG}</p><div class='ad'>buy</div><p>The end.</p><footer>f</footer>", f"{LONG.strip()} The end."),
        (f"<body><nav>m</nav><p>It began.</p><aside>see</aside><p>{LONG}</p><footer>f</footer>", f"It began. {LONG.strip()}"),
        (f"<body><p>{LONG}</p><p>As <a>the long report that we read</a> says.</p><footer>f</footer>", f"{LONG.strip()} As the long report that we read says."),
        (f"<body><article><p>{LONG}</p></article><article><p>Short.</p></article>", f"{LONG.strip()} Short."),
        (f"<article><p>{LONG}</p><p class='share'>They share it.</p><section id='social'><p>A social matter.</p></section></article>", f"{LONG.strip()} They share it. A social matter."),
        (f"<article><p>{LONG}</p><div class='responses'><p>{LONG}</p></div><section class='feedback'><p>me too</p></section></article>", LONG.strip()),
        (f"<article><p>{LONG}</p><article><b>Ann</b><p>I think so, too.</p></article></article>", LONG.strip()),
        (f"<article><p>Short.</p></article><div><p>{LONG}</p></div>", f"Short. {LONG.strip()}"),
        (f"<div><a>Home</a> | <a>News</a></div><div><a>More</a></div><ul><li><a>x</a></ul><p>{LONG}</p>", LONG.strip()),
    ],
)
def test_what_is_kept_and_what_goes(page, text):
    assert html.main_text(page) == text


def brute_main_text(page):
    """All lines from the first run that surges to the last one's end, by looking at each line."""
    rows = html.lines(page)
    size = [0 if not r[0] else len(r[0]) + html.SURGE if r[2] else len(r[0]) if r[1] else 0 for r in rows]
    most = max((sum(size[i : i + html.WINDOW]) for i in range(len(size))), default=0)
    kept = brute_runs(size, html.WINDOW, min(html.SURGE, most)) if most else []
    if not kept:
        return ""
    start = kept[0][0]
    while start and (not rows[start - 1][0] or rows[start - 1][3] and size[start - 1]):
        start -= 1
    head = [i for i in range(start, kept[0][0]) if rows[i][0]]
    first = head[0] if head else kept[0][0]
    return " ".join(r[0] for r in rows[first : kept[-1][1]] if r[0])


def _given(sf):
    import pyarrow.parquet as pq

    return [h for h in pq.read_table(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet", columns=["html"])["html"].to_pylist() if h]


def test_main_text_by_brute_force(sf):
    import random
    import re

    rng = random.Random(8)
    parts = ["<nav>menu</nav>", "<p>short</p>", f"<p>{LONG}</p>", "<h2>Head</h2>", "<div class=ad>ad</div>", "<article>", "</article>", "<div><a>link</a></div>", "<aside>x</aside>", "<footer>f</footer>", "<ul><li>one<li>two</ul>", "<main>", "</main>"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert html.main_text(page) == brute_main_text(page), page
    for page in _given(sf):
        assert html.main_text(page) == brute_main_text(page)
        assert html.main_text(page) == html.main_text(re.sub("</?article>", "", page))  # the sums find the article without its tags


def test_the_sums_alone_decide_on_unmarked_pages(sf):
    """The given pages with no element left but div, p, a and headings: what the sums leave out of these is their doing."""
    import re

    changed = right = total = 0
    for page in _given(sf):
        bare = re.sub(r"</?(?:article|main)>", "", page)
        bare = re.sub(r"<(/?)(?:nav|footer|ul|li)>", r"<\1div>", bare)
        want = html.main_text(page)
        got, every = html.main_text(bare), " ".join(r[0] for r in html.lines(bare) if r[0])
        total, changed, right = total + 1, changed + (got != every), right + (want in got)
    assert changed == total and right == total
