"""The registered queries of this subpackage."""

from __future__ import annotations

from . import decontaminate, dedup, html, mixing, prefix_trie, quality, rans, secrets, simhash, toxicity, urls, warc, whitening

QUERIES = {
    "op1_rans": rans.op1_rans,
    "op2_html": html.op2_html,
    "op3_urls": urls.op3_urls,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality": quality.op8_quality,
    "op9_warc": warc.op9_warc,
    "op10_secrets": secrets.op10_secrets,
    "op11_dedup": dedup.op11_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

#: Words of the contracts, as DuckDB reads the class.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")


def _quality_sql() -> str:
    """Counts by definition; fences by exact ranks, which sketches of up to
    ``SKETCH_K`` values give, too."""
    q = quality
    lists = ", ".join(f"list_sort(list({r})) AS {r}" for r in _RATES)
    ranked = lambda r, p: f"{r}[greatest(1, ceil({p} * n))::INT]"
    fence = ", ".join(f"greatest({ranked(r, q.TAILS[r])}, {ranked(r, 0.5)} + {q.REACH} * ({ranked(r, 0.75)} - {ranked(r, 0.5)})) AS {r}" for r in _RATES)
    pick = ", ".join(f"CASE WHEN g.n >= {q.LEAST_GROUP} THEN g.{r} ELSE l.{r} END AS {r}" for r in _RATES)
    sure = lambda c: f"({c} - {q.NOISE} * sqrt({c}::DOUBLE))"
    least = {"symbol_rate": f"{sure('n_symbols')} / greatest(n_words, 1)", "dup_line_rate": f"{sure('n_dup_lines')} * 10 / greatest(n_words, 1)", "repeat_rate": f"{sure('n_repeat_words')} / greatest(n_words, 1)", "word_length": "c.word_length"}
    within = " AND ".join(f"{least[r]} <= f.{r}" for r in _RATES)
    return rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
k AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT rid, count(DISTINCT i + d) AS n FROM (SELECT rid, i FROM k QUALIFY count(*) OVER (PARTITION BY rid, k) > 1), (SELECT unnest(range(3)) AS d) GROUP BY rid),
b AS (SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(translate(text, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ln FROM t),
m AS (SELECT b.* EXCLUDE (ln), (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN r USING (rid)),
c AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbol_rate, n_dup_lines * 10 / greatest(n_words, 1) AS dup_line_rate, n_repeat_words / greatest(n_words, 1) AS repeat_rate, word_chars / greatest(n_words, 1) AS word_length FROM m),
g AS (SELECT lang, source, n, {fence} FROM (SELECT lang, source, count(*) AS n, {lists} FROM c GROUP BY ALL)),
l AS (SELECT lang, n, {fence} FROM (SELECT lang, count(*) AS n, {lists} FROM c GROUP BY ALL)),
f AS (SELECT g.lang, g.source, {pick} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang),
v AS (SELECT c.*, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed, {within} AS within FROM c JOIN f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept FROM v"""


def _mixing_sql() -> str:
    m = mixing
    weights = "[" + ", ".join(str(w) for w in m.WEIGHTS) + "]"
    return rf"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT *, {m.MOST} * source_size AS ceiling, {weights}[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(m.WEIGHTS)}]::DOUBLE AS weight, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1)),
l AS (SELECT *, ((SELECT {m.SHARE} * sum(source_size) FROM s)::DOUBLE - coalesce(sum(ceiling) OVER w, 0)) / ((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0)) AS level FROM s WINDOW w AS (ORDER BY ceiling / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level AS fixed FROM l WHERE weight * level <= ceiling ORDER BY ceiling / weight, i LIMIT 1),
t AS (SELECT source, source_size, least(ceiling, coalesce(weight * (SELECT fixed FROM v), ceiling))::DOUBLE AS target FROM s),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substring(md5(concat_ws(':', coalesce(d.doc_id::VARCHAR, ''), d.size::VARCHAR, '{m.SEED}')), 1, 15), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - ahead)) END::BIGINT AS taken FROM k"""


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
q AS (SELECT *, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k: '{_BASE32}'[1 + ((('0x' || substring(h, 5 * (k // 4)::INT + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31)]), '') AS payload_digest, page_id IS DISTINCT FROM first AND first IS NOT NULL AND strlen(html) >= {warc.LEAST_BYTES} AS again FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM q"""

def _urls_sql() -> str:
    """Mining by counting all subsets of each labelled url's most telling tokens."""
    u = urls
    order = sorted(u.RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[1]), r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order) + " END"
    shape = "CASE WHEN regexp_full_match(x, '[0-9]+([.][a-z]+)?') THEN x[1] || '#' || length(regexp_extract(x, '^[0-9]+')) ELSE x END"
    return rf"""WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*(.*)$', 1), '^[^?#]*') AS path FROM a),
c AS (SELECT row_number() OVER () AS r, page_id, host, path, {rule} AS rule, {verdict} AS fixed, list_filter(string_split(host, '.'), lambda x: x <> '') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS p, list_filter(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM b),
t AS (SELECT r, page_id, host, path, rule, fixed, list_distinct(list_transform(l, lambda x: 'host:' || x) || CASE WHEN len(l) >= 2 THEN ['domain:' || l[-2] || '.' || l[-1]] ELSE []::VARCHAR[] END || CASE WHEN len(l) >= 1 THEN ['top:' || l[-1]] ELSE []::VARCHAR[] END || list_transform(p, lambda x, i: 'path' || (i - 1) || ':' || {shape}) || list_filter(list_transform(p, lambda x, i: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'path' || (i - 1) || ':^' || x[1] END), lambda x: x IS NOT NULL) || list_transform(q, lambda x: 'query:' || split_part(x, '=', 1))) AS tokens FROM c),
k AS MATERIALIZED (SELECT r, tokens, fixed AS label FROM t WHERE fixed IS NOT NULL AND len(tokens) > 0),
z AS (SELECT count(*) AS total, greatest(ceil({u.SUPPORT} * count(*) - 1e-9), {u.LEAST_ROWS}) AS least FROM k),
lc AS (SELECT label, count(*) AS of_label FROM k GROUP BY 1),
e AS (SELECT r, label, unnest(tokens) AS token FROM k),
h AS (SELECT token, count(*) AS held FROM e, z GROUP BY token, least HAVING count(*) >= least),
g AS (SELECT token, round(sum(CASE WHEN n > 0 THEN n * log2(n * total::DOUBLE / (held * of_label)) ELSE 0 END + CASE WHEN of_label - n > 0 THEN (of_label - n) * log2((of_label - n) * total::DOUBLE / ((total - held) * of_label)) ELSE 0 END), 6) AS gain FROM (SELECT token, held, of_label, total, (SELECT count(*) FROM e WHERE e.token = h.token AND e.label = lc.label) AS n FROM h, lc, z) GROUP BY token),
f AS (SELECT r, label, list(token ORDER BY -gain, token)[1:{u.RULE_TOKENS}] AS best FROM e JOIN g USING (token) GROUP BY ALL),
s AS (SELECT r, label, list_sort(list_filter(best, lambda x, i: (m >> (i - 1)::INT) & 1 = 1)) AS items FROM (SELECT *, unnest(range(1, 1 << len(best))) AS m FROM f)),
fs AS (SELECT DISTINCT items FROM (SELECT items FROM s, z GROUP BY items, label, least HAVING count(*) >= least)),
n AS (SELECT items, label AS verdict, count(*) AS hits FROM fs JOIN k ON list_has_all(k.tokens, fs.items) GROUP BY ALL),
ru AS MATERIALIZED (SELECT items, verdict, hits, hits / sum(hits) OVER (PARTITION BY items) AS confidence FROM n),
ok AS MATERIALIZED (SELECT ru.* FROM ru, z WHERE confidence >= {u.CONFIDENCE} AND hits >= least),
sp AS (SELECT DISTINCT o.items, o.verdict FROM (SELECT items, verdict, confidence, unnest(list_transform(items, lambda x: list_filter(items, lambda y: y <> x))) AS part FROM ok WHERE len(items) > 1) o JOIN ok w ON w.items = o.part AND w.verdict = o.verdict AND w.confidence >= o.confidence),
fi AS (SELECT * FROM ok WHERE (items, verdict) NOT IN (SELECT (items, verdict) FROM sp)),
be AS (SELECT t.r, max(struct_pack(confidence := confidence, hits := hits, fewest := -len(items), verdict := verdict)).verdict AS verdict FROM t JOIN fi ON list_has_all(t.tokens, fi.items) WHERE t.fixed IS NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(fixed, be.verdict, '{u.DEFAULT}') AS verdict FROM t LEFT JOIN be USING (r)"""


def _secrets_sql() -> str:
    """Positions from split lengths, then the battery and its step-up, as plain sums."""
    c, either = secrets, lambda w: "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in w)
    words = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + f"|{either('api')}_?{either('key')}"
    assign = rf"""(?:{words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, f"length(regexp_extract(value, '{assign}', 1)) >= {c.VALUE_CHARS}"), ("access", c.ACCESS, "true"), ("hex", c.HEX, "true"), ("random", c.TOKEN, "true")]
    found = " UNION ALL ".join(f"SELECT r, {k} AS kind, start, start + length(value) AS stop, value FROM (SELECT r, unnest(v) AS value, unnest(list_transform(range(len(v)), lambda i: (list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i], lambda x: length(x))), 0))::BIGINT)) AS start FROM (SELECT r, regexp_extract_all(t, '{p}') AS v, string_split_regex(t, '{p}') AS g FROM d) WHERE len(v) > 0) WHERE {keep}" for k, (_, p, keep) in enumerate(kinds))
    enc = "CASE " + " ".join(f"WHEN regexp_matches(value, '{p}') THEN {i}" for i, (p, _, _) in enumerate(c.ENCODINGS.values())) + " END"
    pick = lambda k: "CASE enc " + " ".join(f"WHEN {i} THEN {v[k]!r}" if k == 1 else f"WHEN {i} THEN {len(v[1]) if k == 0 else v[2]}" for i, v in enumerate(c.ENCODINGS.values())) + " END"
    upper = lambda z: f"(1 / (1 + exp(greatest(-30.0, least(30.0, 1.5976 * ({z}) + 0.07056 * ({z}) * ({z}) * ({z}))))))"
    names = "[" + ", ".join(f"'{k}'" for k in c.KINDS) + "]"
    text = f"{names}[kind + 1] || ':' || start || ':' || stop"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED ({found}),
b AS (SELECT * FROM f WHERE kind < 3),
k AS (SELECT r, start, stop, value, {enc} AS enc FROM f WHERE kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = f.r AND b.start < f.stop AND f.start < b.stop)),
x AS (SELECT *, {pick(0)}::DOUBLE AS size, {pick(2)}::DOUBLE AS cells, list_transform(string_split(CASE WHEN enc IN (0, 2) THEN lower(value) ELSE translate(value, '-_=', '+/') END, ''), lambda y: (instr({pick(1)}, y) - 1)::DOUBLE) AS x FROM k WHERE enc IS NOT NULL),
m AS (SELECT *, len(x)::DOUBLE AS n, list_sum(list_transform(list_transform(range(cells::INT), lambda q: len(list_filter(x, lambda v: floor(v * cells / size) = q))), lambda q: q * q))::DOUBLE AS squares, list_transform(x, lambda v: (v >= size / 2)::INT) AS high, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS dev FROM x),
s AS (SELECT *, (squares * cells / n - n) / (cells - 1) AS chi, 2.0 / (9 * (cells - 1)) AS va, list_sum(high)::DOUBLE AS ups, 1 + list_sum(list_transform(high, lambda e, i: CASE WHEN i > 1 AND e <> high[i - 1] THEN 1 ELSE 0 END)) AS runs, list_sum(list_transform(dev, lambda e: e * e)) AS power, list_sum(list_transform(dev, lambda e, i: CASE WHEN i > 1 THEN e * dev[i - 1] ELSE 0.0 END)) AS near FROM m),
u AS (SELECT *, 2 * ups * (n - ups) / n + 1 AS mu FROM s),
w AS (SELECT *, (mu - 1) * (mu - 2) / (n - 1) AS var FROM u),
q AS (SELECT *, -ln(greatest(least({upper("(pow(chi, 1.0 / 3) - (1 - va)) / sqrt(va)")}, 1.0), 1e-12)) - ln(greatest(least(CASE WHEN var > 0 THEN 2 * {upper("abs(runs - mu) / sqrt(greatest(var, 1e-300))")} ELSE 0.0 END, 1.0), 1e-12)) - ln(greatest(least(CASE WHEN power > 0 THEN 2 * {upper("abs(near / greatest(power, 1e-300) + 1 / n) * sqrt(n)")} ELSE 0.0 END, 1.0), 1e-12)) AS h FROM w),
p AS (SELECT r, start, stop, floor(log2(length(value)))::INT AS class, exp(-h) * (1 + h + h * h / 2) AS p FROM q),
bi AS (SELECT class, least({c.BINS_PER_DECADE * c.MOST_DECADES}, floor(-log10(greatest(p, 1e-300)) * {c.BINS_PER_DECADE}))::INT AS bin, count(*) AS n FROM p GROUP BY ALL),
ra AS (SELECT class, power(10.0, -bin / {c.BINS_PER_DECADE}.0) AS top, sum(n) OVER (PARTITION BY class ORDER BY bin DESC) AS rank, sum(n) OVER (PARTITION BY class) AS m FROM bi),
li AS (SELECT class, max(top) AS lim FROM ra WHERE top <= {c.FDR} * rank / m GROUP BY 1),
al AS (SELECT r, kind, start, stop FROM b UNION ALL SELECT r, 3, start, stop FROM p LEFT JOIN li USING (class) WHERE p > coalesce(lim, 0.0))
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg({text}, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY start, kind), '') AS spans FROM d LEFT JOIN al USING (r) GROUP BY d.r, doc_id"""


_DEDUP = """SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))"""


#: Paths as lists of keys; every node's ancestors are the heads of its list.
_TRIE = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, sha256(strlen(role)::VARCHAR || ':' || role || text) AS k, strlen(text)::BIGINT AS b FROM c),
o AS (SELECT conv_id, list({{'k': k, 'b': b}} ORDER BY turn NULLS FIRST, k) AS s FROM k GROUP BY conv_id),
tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || list_transform(range(8), lambda z: 0::BIGINT), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
h AS (SELECT o.*, conv_id - conv_id % {prefix_trie.GROUP} AS base, (xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda v, x: xor(tab[(xor(v, x) & 255) + 1], v >> 8)), 4294967295) % {prefix_trie.SHARED})::BIGINT AS h FROM o, tab),
r AS (SELECT h.conv_id, coalesce(g.s[1:h], []) || h.s[h + 1:] AS s FROM h LEFT JOIN o AS g ON g.conv_id = base),
x AS (SELECT conv_id, d, d = len(s) AS ends, list_transform(s[1:d], lambda z: z.k) AS p, CASE WHEN d = 0 THEN 0 ELSE s[d].b END AS b FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(b) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM x GROUP BY p, d),
ch AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (p)),
be AS (SELECT p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * b)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS k FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, be.n_leaves, be.saved_tokens, f.ends_sha256 FROM f JOIN be ON be.p = f.p LEFT JOIN f AS g ON f.d > 0 AND g.p = f.p[1:f.d - 1]"""


#: The statements of the operators that SQL can express; the others are tested by brute force.
ORACLE: dict[str, str] = {"op3_urls": _urls_sql(), "op5_mixing": _mixing_sql(), "op8_quality": _quality_sql(), "op9_warc": _WARC, "op10_secrets": _secrets_sql(), "op11_dedup": _DEDUP, "op13_prefix_trie": _TRIE}
