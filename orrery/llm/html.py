"""Main text of web pages by line-block distribution.

A page is cut into tags and text, block-level tags part the text into lines. What
is page furniture by its tag, role or class goes: menus, headers and footers of the
page and comment sections leave ``WINDOW`` empty lines behind, as do the ends of an
``article`` or ``main`` element; adverts, asides, forms and share bars, which stand
inside of texts, too, leave none. Lines outside of an article whose words are all
links count zero. The lengths of ``WINDOW`` neighbouring lines are summed; where the
sum leaves zero and surges to at least ``SURGE`` characters (or to the page's highest
sum, if that is less) a run of text opens, where it dives to zero the run ends. A
line of an article weighs ``SURGE`` more than its characters, so that none is too
short. On every page the text is all that lies between the first surge and the last
dive, with the headings right before: elements only make lines count zero, and text
beside an article counts if it surges.

Reader comments are known by their names, and as articles inside of an article.

Defined results: null and empty html give an empty text; html without any
markup is its own text; unclosed elements end with their parent or the page; an
unclosed comment or script hides the rest of the page; nothing is cut short; rows
that repeat an id or a page are extracted each for itself; an empty table gives an
empty table; other columns stay, but one called ``text`` gives way to the result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 3
SURGE = 80

#: Fixed lists of HTML element names and of furniture's usual names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object canvas audio video select head".split())
FURNITURE = frozenset("nav footer aside form button dialog menu fieldset label".split())
BLOCK = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"br", "html", "body"}
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
#: Names that mean furniture as any part of a class or id, and those that do as the
#: whole of it, or with a word of BOXES (``related-posts``, not ``related-work``).
#: PAGE is the part of NAMES that parts a page's text from the rest of it.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login paywall sharing toolbar pagination pager comments commentlist disqus responses feedback".split()
)
PAGE = frozenset("sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead topbar pagination pager comments commentlist disqus responses feedback".split())
PAGE_TAGS = frozenset("nav footer header menu dialog".split())
PAGE_ROLES = frozenset("navigation banner contentinfo complementary menu menubar".split())
#: Elements of running text, which a name of WEAK says nothing about.
TEXT_TAGS = frozenset("p section blockquote pre figure table h1 h2 h3 h4 h5 h6".split())
WEAK = frozenset("promo promotion banner side menu notice notices notification alert share social related recommended recommendations widget comment reply replies respond skip".split())
BOXES = frozenset("area bar block body box buttons column content form icons item items links list module panel posts section stories widget wrap wrapper container link to".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEEPS_TEXT = frozenset("article main".split())
KEEPS = frozenset("html body".split()) | KEEPS_TEXT
#: An open paragraph or item behind one of these isn't ended by what is inside.
HOLDS = frozenset("ul ol dl table div section article main nav body aside form footer header".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[a-z]+")
_BODY = re.compile(r"<body[\s>]", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What an element is: text, furniture that may stand in a text, or furniture of the page.
TEXT, IN_BODY, OF_PAGE = 0, 1, 2


def _named(word: str, tag: str = "div") -> int:
    """Whether a class or id says that its element is furniture."""
    parts = _PART.findall(word)
    if not NAMES.isdisjoint(parts):
        return IN_BODY if PAGE.isdisjoint(parts) else OF_PAGE
    return IN_BODY if tag not in TEXT_TAGS and any(p in WEAK for p in parts) and all(p in WEAK or p in BOXES for p in parts) else TEXT


def _furniture(tag: str, attrs: str, in_article: bool) -> int:
    if tag in FURNITURE or tag == "header" and not in_article:
        return OF_PAGE if tag in PAGE_TAGS else IN_BODY
    if tag == "article" and in_article:  # a reader's comment
        return OF_PAGE
    if not attrs.strip() or tag in KEEPS:
        return TEXT
    if re.search(r"(?:^|\s)hidden(?=[\s/=]|$)", attrs):
        return IN_BODY
    found = TEXT
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            found = max([found, *(_named(word, tag) for word in value.lower().split())])
        if name == "role" and value.strip().lower() in ROLES:
            found = max(found, OF_PAGE if value.strip().lower() in PAGE_ROLES else IN_BODY)
        if name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDDEN.search(value):
            found = max(found, IN_BODY)
    return found


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, letters and digits outside of links, in the article, in a heading) of each
    line; furniture of the page outside an article, and an article's ends, leave
    ``WINDOW`` empty lines."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, int]] = []  # (tag, what of it is hidden)
    hidden = article = nested = links = headings = 0
    opened: Counter[str] = Counter()
    never: set[str] = set()  # elements that nothing closes from here on
    text: list[str] = []
    free = 0
    pos, end = 0, len(page)

    def close_line() -> None:
        nonlocal free
        line = " ".join("".join(text).split())
        if line:
            out.append((line, free, article > 0, headings > 0))
        text.clear()
        free = 0

    def gap() -> None:
        if not article:
            out.extend([("", 0, False, False)] * WINDOW)

    def pop_to(k: int) -> None:
        nonlocal hidden, article, nested, links, headings
        while len(stack) > k:
            tag, hides = stack.pop()
            opened[tag] -= 1
            hidden -= hides > 0
            article -= tag in KEEPS_TEXT
            nested -= tag == "article"
            if tag in KEEPS_TEXT and not hidden:
                gap()
            if hides == OF_PAGE:
                gap()
            links -= tag == "a"
            headings -= tag in HEADINGS

    def last_open(tags: tuple[str, ...], stop: frozenset[str] = frozenset()) -> int | None:
        """Where the innermost open element of these is, none behind a stop."""
        if any(opened[t] for t in tags):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in stop:
                    break
        return None

    while pos < end:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                if not hidden:
                    got = entities.unescape(raw)
                    text.append(got)
                    if not links and article == 0:  # inside an article all lines count
                        free += sum(map(str.isalnum, got))
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCK and not hidden:
            close_line()
        if closing:
            k = last_open((tag,))
            if k is not None:
                pop_to(k)
            continue
        if tag in RAW:
            if attrs.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            over = None if tag in never else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            if over:
                pos = over.end()
            elif tag != "head":
                pos = end
            elif tag not in never:  # an unclosed head ends where the body begins
                never.add(tag)
                body = _BODY.search(page, pos)
                pos = body.start() if body else pos
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P or tag in ITEMS:
            k = last_open((("p",) if tag in ENDS_P else ()) + ITEMS.get(tag, ()), HOLDS)
            if k is not None:
                pop_to(k)
        hides = TEXT if hidden else _furniture(tag, attrs, nested > 0 if tag == "article" else article > 0)
        if hides:
            close_line()
        if hides == OF_PAGE or tag in KEEPS_TEXT and not hidden:
            gap()
        stack.append((tag, hides))
        opened[tag] += 1
        hidden += hides > 0
        article += tag in KEEPS_TEXT
        nested += tag == "article"
        links += tag == "a"
        headings += tag in HEADINGS
    close_line()
    return out


def window_sums(lengths: list[int], window: int = WINDOW) -> list[int]:
    """The characters in each line and the window - 1 lines behind it."""
    upto = [0, *accumulate(lengths)]
    return [upto[min(i + window, len(lengths))] - upto[i] for i in range(len(lengths))]


def runs(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, past last) lines of each run: it opens where the window's sum
    leaves zero, closes where it is zero again, and counts if it surges."""
    out, first, top = [], None, 0
    for i, total in enumerate([*window_sums(lengths, window), 0]):
        if first is None and total and lengths[i]:
            first, top = i, 0
        top = max(top, total)
        if first is not None and not total:
            if top >= max(surge, 1):
                out.append((first, i))
            first = None
    return out


def weights(rows: list[tuple[str, int, bool, bool]]) -> list[int]:
    """What each line counts for: its characters and in an article ``SURGE`` more;
    nothing if it is empty, or if it is outside and has no word that isn't a link."""
    return [len(row[0]) + SURGE if row[2] and row[0] else len(row[0]) if row[1] else 0 for row in rows]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    rows = lines(page)
    lengths = weights(rows)
    sums = window_sums(lengths)
    kept = runs(lengths, surge=min(SURGE, max(sums, default=0)))
    if not kept:
        return ""
    first, last = kept[0][0], kept[-1][1]
    # furniture inside the block ends nothing, nor does it part the text from its heading
    for i in range(first - 1, -1, -1):
        if lengths[i] and rows[i][3]:
            first = i
        elif rows[i][0]:
            break
    return " ".join(row[0] for row in rows[first:last] if row[0])


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with ``text`` in place of the html; other columns stay."""
    rest = [c for c in pages.columns if c not in (html_col, "text")]

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], [*rest, "text"])

    rows = pages.select(*rest, F.col(html_col).cast("string"))
    schema = pages.select(*rest, F.lit("").alias("text")).schema
    return rows.mapInArrow(run, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
