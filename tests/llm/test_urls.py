import duckdb
from pyspark.sql import functions as F

from tracery.llm import urls


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None), "no scheme/a": ("", "", None), "http://X.Net": ("x.net", "", None), "http://X.Net/": ("x.net", "/", "net/"),
        "https://a.example.NET/en/1?x=/y#z": ("a.example.net", "/en/1", "example.net/en/"), "http://notexample.net/en/": ("notexample.net", "/en/", "net/"),
        "x://example.com/de/?q": ("example.com", "/de/", "example.com/de/"), "x://myexample.com/de/": ("myexample.com", "/de/", None),
        "http://org/fr/a": ("org", "/fr/a", "org/fr/"), "http://a.org#/fr/": ("a.org", "", None), "http://É.org?x://y": ("É.org", "", None), "://": ("", "", None), "": ("", "", None),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = urls.judge_pages(pages, labels).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        host, path, rule = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == ({t: v for v, t in urls.RULES}[rule] if rule else "allow")
    assert urls.judge_pages(pages.limit(0), labels).count() == 0


def test_tree_rejects_the_bad_branch_and_merges_like_ones(spark):
    rows = [(f"http://h.com/{kind}/{i}", good) for kind, good in (("spam", False), ("news", True), ("blog", True)) for i in range(60)]
    rows += [(f"http://h.com/tags/tag-{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i % 3]}/p", True) for i in range(78)]
    df = spark.createDataFrame(rows, "url string, good boolean")
    out = urls.judge(df, df, F.col("url"), rules=[])
    by = {r.url: r for r in out.collect()}
    assert by["http://h.com/spam/3"].verdict == "block" and by["http://h.com/news/5"].verdict == "allow"
    assert by["http://h.com/spam/3"].template == "/spam/*"
    assert {r.template for u, r in by.items() if "/tags/" in u} == {"/tags/*/p"} or {r.template for u, r in by.items() if "/tags/" in u} == {"/*/*/p"}
    few = spark.createDataFrame([("http://k.com/a/1", False)], "url string, good boolean")
    assert urls.judge(few, few.union(df), F.col("url"), rules=[]).first().verdict == "allow"  # one label is too few


def test_tree_reaches_the_deepest_path(spark):
    slug = lambda i: "abcdefghijklmnopqrstuvwxyz"[i % 26] + "-" + "abcdefghijklmnopqrstuvwxyz"[i // 26]
    rows = [(f"http://h.com/a/b/c/d/{kind}/x/{slug(i)}", good) for kind, good, n in (("spam", False, 60), ("news", True, 120)) for i in range(n)]
    rows += [("http://h.com/a/b/c/d/lone" + "/deep" * 200, True), ("http://h.com/a/b/c/d", True), ("http://h.com", True)]
    df = spark.createDataFrame(rows, "url string, good boolean")
    by = {r.url: r for r in urls.judge(df, df, F.col("url"), rules=[]).collect()}
    assert len(by) == len(rows)
    for u, r in by.items():
        assert r.verdict == ("block" if "/spam/" in u else "allow")
        if "/spam/" in u or "/news/" in u:
            assert r.template == u[len("http://h.com") : u.rindex("/")] + "/*"
    assert by[rows[-3][0]].template.endswith("/deep" * 200) and by["http://h.com"].template == ""


def test_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = urls.judge_pages(spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = con.execute(urls.oracle())
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
