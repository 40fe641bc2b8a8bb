"""Targets of canonical links and refreshes, relative ones and later tags too."""

import random
from urllib.parse import urljoin, urlsplit

import duckdb
import pytest
from pyspark.sql import functions as F

from lexvane.llm import url_filter

PAGES = ["http://x.net/a/b/p.html?q=1#f", "http://x.net", "http://X.net/", "http://x.net/a/"]
TARGETS = ["page2.html", "./x", "../x", "../../../x", "?id=3", "/c", "/a/./b/../c", "//y.net/d", "http://y.net/e?u=http://z.net", "go?u=http://y.net/../z", "s/../t/.", "..", ".", "d/..?q#f"]


def test_resolve(spark):
    pairs = spark.createDataFrame([(p, t) for p in PAGES for t in TARGETS], "p string, t string")
    got = pairs.select("p", "t", url_filter.url_key(url_filter.resolve(F.col("p"), F.col("t"))).alias("k")).collect()

    def key(url):
        u = urlsplit(url)
        return u.netloc.lower() + u.path + (f"?{u.query}" if u.query else "")

    for r in got:  # on a page without a path, urljoin leaves out the / before ?
        want = key(urljoin(r["p"] if urlsplit(r["p"]).path or r["t"].startswith("?") else r["p"] + "/", r["t"]))
        assert r["k"] == want, r
    none = spark.createDataFrame([(PAGES[0], t) for t in ("mailto:a@b", "javascript:x()", "#f", "")], "p string, t string")
    assert none.filter(url_filter.resolve(F.col("p"), F.col("t")).isNotNull()).count() == 0


@pytest.mark.parametrize(
    "html",
    [
        '<link rel="canonical" href="../es/x">',
        '<link rel=canonical href="/elsewhere"><link rel=canonical href="../es/x">',
        '<meta http-equiv="refresh" content="9; url=/later"><meta http-equiv=refresh content="0; url=./../es/x">',
    ],
)
def test_relative_and_later_targets_block(spark, html):
    pages = spark.createDataFrame([(1, "http://example.org/fr/a", html), (2, "http://example.org/es/x", "")], "page_id long, url string, html string")
    rules = [("block", "example.org/es/")]
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()} == {1: "block", 2: "block"}


@pytest.mark.parametrize(
    ("url", "html", "want"),
    [
        ("http://a.net/x", """<link rel=canonical href="http://shop.com/de's/z">""", ["shop.com/de's/z"]),
        ("http://a.net/x", """<link rel='canonical' href='/a"b>c'>""", ['a.net/a"b>c']),
        ("http://a.net/x", '<link rel=canonical data-href="http://bad.com/" href="http://good.com/">', ["good.com/"]),
        ("http://a.net/x", """<link title="href='http://bad.com/'" rel=canonical href=/y>""", ["a.net/y"]),
        ("http://a.net/x", "<!-- <link rel=canonical href=/gone> --><link rel=canonical href=/kept><!-- <link rel=canonical href=/open>", ["a.net/kept"]),
        ("http://a.net/x/y", "<base href='http://b.net/f/g'><link rel=canonical href=z>", ["b.net/f/z"]),
        ("https://a.net/x/y", "<base target=_top><base href=../q/><base href=/other/><link rel=canonical href=z>", ["a.net/q/z"]),
        ("http://f.net:80/y", "<link rel=canonical href=http://f.net/x>", ["f.net/x"]),
        ("https://f.net:443/y", "<link rel=canonical href=x><link rel=canonical href=//f.net:443/z><link rel=canonical href=http://f.net:443/w>", ["f.net/x", "f.net/z", "f.net:443/w"]),
        ("http://a.net/x", "<link rel='nofollow Canonical' href=/y><link rel=canonicals href=/n><linker rel=canonical href=/n>", ["a.net/y"]),
        ("http://a.net/x", """<meta content='3 ; URL="/r;s"' http-equiv=Refresh><meta http-equiv=refresh content=5><meta name=refresh content="0;url=/n">""", ["a.net/r;s"]),
        ("http://a.net/x", "<link rel=canonical href=/first href=/second><link rel=canonical href><link rel=canonical href=''>", ["a.net/first"]),
    ],
)
def test_targets_of_tags(spark, url, html, want):
    """Quotes, names that end alike, comments, base tags, default ports and token lists."""
    rows = url_filter.link_edges(spark.createDataFrame([(url, html)], "url string, html string")).collect()
    assert sorted(r["dst"] for r in rows) == sorted(want)
    assert {r["src"] for r in rows} <= {url.split("://")[1].replace(":80/", "/").replace(":443/", "/")}


def test_query_and_sql_on_linked_pages(spark, tmp_path):
    """Chains, relative targets, several tags, entities, cycles, hot targets and allow precedence, in Spark and in SQL."""
    rng = random.Random(3)
    hosts, folders = ["example.org", "a.Example.org", "shop.com", "shop.com:80", "x.net:443", "b.shop.com", "x.net", "y.net"], ["/es/", "/en/1", "/en/2/", "/fr/", "/de/", "/", "/q/r/"]
    urls = [f"http{'s' * (i % 2)}://{rng.choice(hosts)}{rng.choice(folders)}{rng.choice(['', 'p', 'q?i=1&j=2', 's#t'])}{i % 40}" for i in range(300)] + [None, "no scheme", "http://x.net", "http://x.net"]

    def target():
        return rng.choice([rng.choice(urls[:300]).replace("&", "&amp;"), *TARGETS, "mailto:a@b", "#f", f"../{rng.choice(['es', 'de', 'fr'])}/p{rng.randrange(40)}", "//Shop.com/de/hot", "/a//b", "./..", "../../x/./?k=/../"])

    def tag():
        return rng.choice([f'<link rel="canonical" href="{target()}">', f"<LINK href='{target()}' REL=canonical>", f'<meta http-equiv="refresh" content="0; url={target()}">', "<link rel=icon href=/i>", "<p>", f'<link data-href="/de/x" title="rel=canonical >" rel="x canonical" href="{target()}">', f"<!-- <link rel=canonical href='{target()}'> -->", f"<base href='{target()}'>", f"<link rel=canonical href=\"/de's/{rng.randrange(9)}\">", f"<meta content=\"0;url='{target()}'\" http-equiv=REFRESH>"])

    rows = [(i, u, None if i % 29 == 0 else " ".join(tag() for _ in range(rng.choice([0, 0, 1, 1, 2, 3])))) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = con.sql(url_filter.ORACLE)
    assert found.columns == got.columns
    rows_got, rows_sql = (sorted(map(repr, x)) for x in (map(tuple, got.collect()), found.fetchall()))
    assert rows_got == rows_sql
    assert {r["verdict"] for r in got.filter("rule is null").collect()} == {"allow", "block"} and got.filter("alias_of is not null").select("alias_of").distinct().count() < 280
