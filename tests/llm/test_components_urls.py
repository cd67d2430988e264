import random

from helpers import dicts, groups, same, sql
from tripwave.llm.components import connected_components
from tripwave.llm.queries import URL_RULES, URL_SQL
from tripwave.llm.urls import judge

PAGES = "page_id long, url string, html string"


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    n = 120
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)] + [(i, i + 1) for i in range(60, 100)] + [(110, 110), (111, 5)]
    want = groups(n, links)
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert got == {x: want[x] for pair in links for x in pair}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def link(kind, to):
    return {"c": f'<head><link rel="canonical" href="{to}"></head>', "r": f"<meta http-equiv='refresh' content='0; URL={to}'>",
            "x": f'<LINK data-x=1 REL=canonical HREF={to}>', "t": f'<link href="{to}" rel="canonical"/>'}[kind]


ROWS = [
    (1, "http://bad.net/a", ""), (2, "https://mirror.com/a", link("c", "http://bad.net/a")),
    (3, "https://other.com/b?q=1#top", link("r", "//mirror.com/a")), (4, "http://www.Example.NET/en/1", link("c", "http://bad.net/a")),
    (5, "http://plain.org/fr/x", link("x", "http://www.example.net/de/9")), (6, "http://plain.org/es/x", link("c", "/fr/x")),
    (7, "http://alone.com/", link("c", "#here")), (8, "http://rel.com/d/e.html", link("t", "../x")), (9, "http://rel.com/d/f", link("c", "e.html")),
    (10, "ftp.example.com", None), (11, None, None), (12, "http://net", link("c", "http://y.com/1?a=1&amp;b=2")),
    (13, "https://y.com/1?a=1&b=2#z", ""), (14, "http://example.com/de/", ""), (15, "http://example.com/de", ""), (1, "http://bad.net/a", ""),
    (16, "http://a.com?x=http://b.net/", ""), (17, "", ""), (18, "http://", link("c", "http://bad.net/a")), (19, "http://chain.com/1", link("c", "/2")),
    (20, "http://chain.com/2", link("c", "/3")), (21, "http://chain.com/3", link("c", "http://sub.example.com/de/q")),
]


def test_aliases_and_precedence(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    got = dicts(judge(pages.selectExpr("*", "1 as host", "2 as verdict"), URL_RULES))
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert len(got) == len(ROWS)
    assert [verdict[i] for i in (1, 2, 3)] == ["block"] * 3          # an alias of an alias
    assert verdict[4] == "allow"                                     # its own rule goes first
    assert verdict[5] == "allow" and verdict[6] == "block"           # blocked through example.net/de, but for the rule
    assert [verdict[i] for i in (7, 8, 9, 10, 11, 12, 13, 15, 16, 17)] == ["allow"] * 10
    assert [verdict[i] for i in (14, 19, 20, 21)] == ["block"] * 4
    assert same(got, sql(URL_SQL, pages=pages))


def test_refresh_targets_and_all_tags(spark):
    refresh = lambda content: f"<meta http-equiv=refresh content={content}>"
    rows = [
        (1, "http://mid.com/x?p=1&q=2", link("c", "http://bad.net/a")), (2, "http://mid.com/y;s=1?k=2;l=3", link("c", "http://bad.net/a")),
        (3, "http://amp.com/", refresh('"0; url=http://mid.com/x?p=1&amp;q=2"')), (4, "http://semicolon.com/", link("r", "http://mid.com/y;s=1?k=2;l=3")),
        (5, "http://inner.com/", refresh("\"0;URL='http://mid.com/x?p=1&amp;q=2' \"")), (6, "http://bare.com/", refresh("0;url=//mid.com/x?p=1&amp;q=2")),
        (7, "http://first.com/", "<meta content='5; url = http://mid.com/x?p=1&amp;q=2 ' http-equiv='refresh'>"),
        (8, "http://canonicals.com/", link("c", "http://fine.com/") + link("t", "http://mid.com/x?p=1&amp;q=2")),
        (9, "http://refreshes.com/", link("r", "http://fine2.com/") + refresh('"9"') + link("r", "http://mid.com/x?p=1&q=2")),
        (10, "http://mid.com/x?p=1", refresh("30")), (11, "http://mid.com/y", ""), (12, "http://mid.com/x?p=1&amp", "")]
    pages = spark.createDataFrame(rows, PAGES)
    judged = dicts(judge(pages, URL_RULES))
    assert same(judged, sql(URL_SQL, pages=pages))
    got = {r["page_id"]: r["verdict"] for r in judged}
    assert got == {i: "block" if i < 10 else "allow" for i in range(1, 13)}


def test_crawled_redirects_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", None)], PAGES)
    redirects = spark.createDataFrame([("http://a.com/x", "http://b.net/y"), (None, "http://b.net/y"), ("http://c.com", None)], "url string, target string")
    assert judge(pages, URL_RULES, redirects).first()["verdict"] == "block"
    assert judge(pages, ()).first()["verdict"] == "allow"
    assert judge(pages.limit(0), URL_RULES).count() == 0
