"""Every operator with a SQL statement gives what DuckDB gives for it."""

import duckdb
import pytest

from orrery.llm import queries
from tests.test_oracle import TABLES


def canon(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, sf, name, size):
    folder, con = sf.replace("sf0.001", size), duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, folder), con.execute(queries.ORACLE[name])
    names, rows = [c[0] for c in want.description], want.fetchall()
    assert sorted(got.columns) == sorted(names) and len(rows) > 0
    assert canon(got.columns, got.collect()) == canon(names, rows)


def _tokens(rng, n):
    """Random keys of several encodings and lengths, and tokens that only look like them."""
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    words = ["model", "path", "report2", "final", "version", "2024", "data", "chapter", "x1", "user_name"]
    keys = ["".join(rng.choice(alphabets[k % 4]) for _ in range(rng.choice((20, 22, 40, 64, 100)))) for k in range(n)]
    plain = ["".join(rng.choice(words) + rng.choice(("_", "-", "/", "")) for _ in range(rng.randrange(4, 14))) for _ in range(n)]
    plain += [("ab12" * 20)[: rng.randrange(20, 70)] for _ in range(n // 4)] + ["1234567890" * 3 + "abc" * k for k in range(1, n // 4)]
    return keys, plain


def test_the_battery_and_its_limits_in_sql(spark, tmp_path):
    import random

    rng = random.Random(9)
    keys, plain = _tokens(rng, 120)
    texts = [f"see {t}, then \U0001f600 token={t[:9]} AKIA{t.upper()[:3]} {t[::-1]}" for t in [*keys, *plain]] + [None, "", "no token"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, keys[0])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = queries.QUERIES["op10_secrets"](spark, str(tmp_path)), con.execute(queries.ORACLE["op10_secrets"])
    names, rows = [c[0] for c in want.description], want.fetchall()
    found = got.collect()
    assert canon(got.columns, found) == canon(names, rows)
    added = sum(r.spans.count("random:") for r in found)
    assert 100 < added < 2 * (len(keys) + len(plain))


def test_rules_over_odd_urls_in_sql(spark, tmp_path):
    import random

    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    seen = [f"http{pick('', 's')}://{pick('a', 'b', 'WWW')}.{pick('x', 'y')}.{pick('org', 'com', 'net', 'info')}{pick('/de/', '/fr/', '/q/', '/en/')}{rng.randrange(300)}{pick('', '?p=1&q', '#top')}" for _ in range(400)]
    rows = [(i, u, "") for i, u in enumerate([*seen, None, "", "nourl", "x://", "x://HOST", "y://h.com//a//b/1.html?=&x"])] + [(1, seen[1], "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got, want = queries.QUERIES["op3_urls"](spark, str(tmp_path)), con.execute(queries.ORACLE["op3_urls"])
    names, rows = [c[0] for c in want.description], want.fetchall()
    assert canon(got.columns, got.collect()) == canon(names, rows) and {r[names.index("verdict")] for r in rows} == {"allow", "block"}
