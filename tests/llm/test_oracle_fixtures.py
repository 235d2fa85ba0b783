"""The SQL of the operators on small tables that hold what the given ones lack."""

import duckdb
import pytest

from cadenza.llm.license_scan import FULL_TEXTS
from cadenza.llm.queries import LLM_ORACLE, LLM_QUERIES
from test_native_scans import LINK_CASES


def _same(spark, key, path, tables):
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    got = LLM_QUERIES[key](spark, str(path))
    want = con.sql(LLM_ORACLE[key])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    mine = sorted(repr([r[c] for c in cols]) for r in got.collect())
    theirs = sorted(repr([row[want.columns.index(c)] for c in cols]) for row in want.fetchall())
    assert mine == theirs


def test_urls_with_links(spark, tmp_path):
    canon, refresh = '<link rel="canonical" href="{}">', '<META content="3;URL=\'{}\'" http-equiv="Refresh">'
    rows = [(i, f"http://h{i}.com/p?q={i}#x", canon.format(f"http://h{i + 1}.com/p?q={i + 1}")) for i in range(12)]
    rows += [(20, "http://h12.com/p?q=12", refresh.format("https://bad.net/a")), (21, "http://h30.com/", canon.format("//good.org/fr/1")),
             (22, "http://h31.com/", canon.format("//h30.com/") + refresh.format("/local")), (23, "http://h31.com/local", canon.format("http://bad.net/a2")),
             (24, "http://bad.net/a2", None), (25, None, canon.format("http://x.net/")), (26, "none", ""), (27, "http://sub.example.com/de/1", "")]
    rows += [(100 + i, u, h) for i, (u, h, _) in enumerate(LINK_CASES)]
    rows += [(200, "http://a.com/p", canon.format("/login?next=https://spam.net/x")), (201, "http://a.com/q", canon.format("r.html?x=1&amp;y=2")),
             (202, "http://a.com/r.html?x=1&y=2", canon.format("//bad.net/")), (203, "http://b.com/d/e", canon.format("../q.html") + refresh.format("r.html")),
             (204, "http://b.com/q.html", "<BASE HREF='//deep.net/x/y'>" + canon.format("z")), (205, "http://b.com/d/r.html", canon.format("#frag")),
             (206, "http://c.com/\u212a", "<lin\u212a rel=canonical href=//bad.net/>"), (207, "http://c.com/..%2f", canon.format("&#0;&#xD800;&#x110000;&#65;&lt"))]
    _same(spark, "op3_url_filter", tmp_path, {"pages": spark.createDataFrame(rows, "page_id long, url string, html string")})


@pytest.mark.parametrize("key", ["op4_license_scan", "op5_secret_scan", "op9_host_rules"])
def test_odd_documents(spark, docs_of, tmp_path, key):
    rows = [(1, None, "a"), (2, "", "a"), (3, "Released\tunder the MIT\nLicense.\n\nReleased under the MIT License!", "b"),
            (4, "token=secret=abcdef password : 'x/y+z_1' TOKEN=abc AKIA" + "Z" * 20 + " 0123456789abcdef01234567", "b"),
            (5, "é𝄞 api-key api_key=abcdef\n" * 40, None), (6, "w " * 60 + "#|", "c"), (7, "one two three four five " * 12, "c"),
            (8, "\x0b\x0c tab\tseparated\r\nlines \n \nlines ", "d"), (9, "ſecret=abcdefgh toKen=abcdefgh", "d")]
    words = [w for _, t in FULL_TEXTS for w in t.split()]
    rows += [(20 + i, ("\n# " if i % 2 else " ").join(words[40 * i:40 * i + 90])) for i in range(12)]
    rows += [(50, "see This project is Licensed under the MIT License. Licensed under the MIT\nlicense, or Licensed under the Apache License, Version 2.0 now")]
    _same(spark, key, tmp_path, {"documents": docs_of(rows)})
