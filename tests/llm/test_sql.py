"""The SQL of the queries against planted redirects and canonical links."""

import duckdb

from rootweave.llm import queries, urls


def test_url_sql(spark):
    refresh, canonical = '<meta http-equiv="refresh" content="0; url=%s">', '<link href="%s" rel="canonical"/>'
    pages = [
        (1, "http://A.example.net/en/1", ""),
        (2, "http://x.net/en/1", None),
        (3, "http://x.net", None),
        (4, "https://one.com/a?q=1#f", refresh % "http://bad.example.com/de/x"),
        (5, "http://one.com/a?q=1", ""),
        (6, "http://two.com/b", canonical % "/c"),
        (7, "http://two.com/c/", refresh % "//one.com/a?q=1"),
        (8, "http://good.org/fr/z", refresh % "http://y.net/x2"),
        (9, "http://three.com/", canonical % "http://good.org/fr/z"),
        (12, "http://example.com/de/", ""),
        (13, "http://four.com/a", canonical % "http://example.com/de"),
        (14, "http://five.com/a", canonical % "/b" + "x" * 100_000 + canonical % "http://y.net/x3"),
        (15, "http://six.com/a", refresh % "/login?next=http://y.net/x4"),
        (16, "http://six.com/login?next=http://y.net/x4", ""),
        (10, None, None),
        (10, None, None),
        (11, "no scheme", ""),
    ]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = sorted(str(tuple(r)) for r in urls.judge_urls(rows, queries.URL_RULES).collect())
    verdict = {r.page_id: r.verdict for r in urls.judge_urls(rows, queries.URL_RULES).collect()}
    assert verdict[13] == verdict[14] == "block" and verdict[15] == verdict[16] == "allow"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert found == sorted(map(str, con.execute(queries.OP3_SQL).fetchall()))
