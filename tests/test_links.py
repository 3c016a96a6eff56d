import pytest
from pyspark.sql import functions as F

from hostledger.operators import graph as G
from hostledger.operators import links as L

DOC = """<!DOCTYPE html><title><a href="/no"></title><!-- <a href="/c"> --> <A class=x HREF = '/a&amp;b?x=1&#233;&copy=2' >t</A>
<div title="<a href=/inattr>"> <img src="/i.png" srcset="/s1.png 1x, /s2.png 2x"><source srcset=" /s3.png ">
<script src=/x.js>var a="<a href='/js'>";</script><a href=mailto:x><a href="  "><a href=""><link rel=stylesheet href=/y.css/>
<form action=go?z><object data="d.swf"></object><embed src='../e'><iframe src="//o.com/f"><a href="/inframe"></iframe>
<a href="/aa/aa"><a data-href="/d" href="/h" href="/second"><a href="http://q.com/?r#f"/><!-- unclosed <a href="/never">"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "https://h.com/p/q.html", DOC),
        (2, "https://h.com/", "<a " + "x" * 300000 + " href='/big'>" + "<a href=/z>" * 3),
        (3, "https://h.com", "<script>" + "<b> " * 50000 + "</script><a href=ok>"),
        (4, "http://g", "<!--" + "-a" * 50000 + "--><a href=k.css>"),
        (5, "http://g", ""),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_extract_links(pages):
    rows = L.extract_links(pages).orderBy("page_id", "srcset", "tag_pos", "item").collect()
    assert [(r["asset_type"], r["attr"], r["link"]) for r in rows if r["page_id"] == 1] == [
        ("a", "href", "https://h.com/a&b?x=1é&copy=2"),
        ("img", "src", "https://h.com/i.png"),
        ("script", "src", "https://h.com/x.js"),
        ("link", "href", "https://h.com/y.css/"),
        ("form", "action", "https://h.com/p/go?z"),
        ("object", "data", "https://h.com/p/d.swf"),
        ("embed", "src", "https://h.com/e"),
        ("iframe", "src", "https://o.com/f"),
        ("a", "href", "https://h.com/h"),
        ("a", "href", "http://q.com/?r#f"),
        ("img", "srcset", "https://h.com/s1.png"),
        ("img", "srcset", "https://h.com/s2.png"),
        ("img", "srcset", "https://h.com/s3.png"),
    ]
    assert [r["link"] for r in rows if r["page_id"] == 2] == ["https://h.com/big"] + ["https://h.com/z"] * 3
    assert [r["link"] for r in rows if r["page_id"] in (3, 4)] == ["https://h.com/ok", "http://g/k.css"]


def test_extract_links_has_no_shuffle_and_drops_html(pages):
    plan = L.extract_links(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_inventory_and_discovery(pages, spark):
    seeds = spark.createDataFrame([(0, "https://h.com/")], "pos bigint, url string")
    hosts = spark.createDataFrame([("h.com",), ("g",)], "host string")
    links = L.extract_links(pages)
    marked = L.mark_scope(links, seed_hosts=hosts)
    counts = {(r["page_id"], r["in_scope"]): 0 for r in L.asset_inventory(marked).collect()}
    assert (1, True) in counts and (1, False) in counts
    found = {r["url"] for r in L.discovered_urls(links, seeds, scope={"seed_hosts": hosts}).collect()}
    assert "https://h.com/" in found and "https://h.com/big" in found
    assert not any("o.com" in u or u.endswith((".js", ".css")) for u in found)
    every = {r["url"] for r in L.discovered_urls(links, None, enabled=False, scope={"seed_hosts": hosts}).collect()}
    assert {"https://h.com/z", "https://h.com/i.png"} <= every


def test_link_edges_last_page_wins(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/1", "<a href=/x?utm_source=1>"), (2, "http://a/2#f", "<a href=/x>")],
        "page_id bigint, url string, html string",
    )
    assert [tuple(r) for r in L.link_edges(L.extract_links(pages)).collect()] == [("http://a/x", "http://a/2")]


@pytest.fixture(scope="module")
def graph(spark):
    chain = [(f"http://c/{i + 1}", f"http://c/{i}") for i in range(40)]
    cycle = [("http://y/1", "http://y/2"), ("http://y/2", "http://y/3"), ("http://y/3", "http://y/1")]
    below_cycle = [("http://y/4", "http://y/1")]
    loose = [("http://s2/child", "http://nowhere/root")]
    seed_link = [("http://c/0", "http://c/40")]
    edges = spark.createDataFrame(chain + cycle + below_cycle + loose + seed_link, "child string, parent string")
    seeds = spark.createDataFrame([(5, "http://s2/late"), (1, "S2/first"), (0, "http://c/0")], "pos bigint, url string")
    return edges, seeds


def test_root_target(spark, graph):
    edges, seeds = graph
    urls = spark.createDataFrame(
        [(u,) for u in ["http://c/0", "http://c/40", "http://y/4", "http://s2/child", "http://o:81/x", "http://a b/"]], "url string"
    )
    roots = {r["url"]: (r["root_target"], r["via"]) for r in G.root_target(urls, edges, seeds).collect()}
    assert roots == {
        "http://c/0": ("http://c/0", "seed"),
        "http://c/40": ("http://c/0", "chain"),
        "http://y/4": ("http://y", "site"),
        "http://s2/child": ("S2/first", "host"),
        "http://o:81/x": ("http://o:81", "site"),
        "http://a b/": ("http://a b/", "self"),
    }


def test_crawl_frontier(spark, graph):
    edges, seeds = graph
    depth = {r["url"]: r["depth"] for r in G.crawl_frontier(edges, seeds.where("pos = 0"), max_depth=5).collect()}
    assert depth == {f"http://c/{i}": i + 1 for i in range(5)}


def test_long_chain_beside_a_cycle(spark):
    """A chain longer than any fixed number of hops; the cycle ends the rounds without an answer."""
    n = 100_000
    chain = spark.range(n).select(F.concat(F.lit("c"), F.col("id") + 1).alias("child"), F.concat(F.lit("c"), F.col("id")).alias("parent"))
    cycle = spark.range(7).select(F.concat(F.lit("y"), "id").alias("child"), F.concat(F.lit("y"), (F.col("id") + 1) % 7).alias("parent"))
    found = G.seed_ancestors(chain.union(cycle), spark.createDataFrame([("c0",)], "url string"))
    assert found.agg(F.count("*"), F.count_if(F.col("root") == "c0")).first() == (n, n)


def test_references_of_any_length_and_name(spark):
    links = {
        "/p?a&#00000061;b": "/p?a=b", "/x&#x00000041;": "/xA", "/caf&eacute;": "/caf%C3%A9", "/?x=1&ampy=2": "/?x=1&ampy=2",
        "/a&amp;b": "/a&b", "/a&copy": "/a%C2%A9", "/&#128;": "/%E2%82%AC", "/&#99999999999;": "/%EF%BF%BD", "/&nosuchname;": "/&nosuchname;",
    }
    pages = spark.createDataFrame([(i, "http://h.com/", f'<a href="{raw}">') for i, raw in enumerate(links)], "page_id long, url string, html string")
    got = {r["page_id"]: r["link"] for r in L.extract_links(pages).collect()}
    assert got == {i: "http://h.com" + link for i, link in enumerate(links.values())}


def test_rejected_links_can_be_counted(spark):
    page = f"<a href='/ok'><a href='mailto:x'><a href='/{'y' * 1200}'><a href='/js/js'><a href='/%zz'>"
    pages = spark.createDataFrame([(1, "http://h.com/", page)], "page_id long, url string, html string")
    reasons = {r["tag_pos"]: r["reject_reason"] for r in L.extract_links(pages, rejected=True).collect()}
    assert list(reasons.values()) == [None, "skippable", "invalid", "trap", "unresolved"]
    assert L.extract_links(pages).count() == 1
    assert L.extract_links(pages, limits=False).count() == 2


def test_host_rules_ignore_case(spark):
    links = spark.createDataFrame([("http://EVIL.com/a",), ("HTTPS://Ex.com/b",), ("http://other.com/",)], "link string")
    seeds = spark.createDataFrame([("ex.com",), ("evil.com",)], "host string")
    got = {r["link"]: r["in_scope"] for r in L.mark_scope(links, seed_hosts=seeds, disallowed_hosts=("Evil.com",)).collect()}
    assert got == {"http://EVIL.com/a": False, "HTTPS://Ex.com/b": True, "http://other.com/": False}


def test_hot_parent(spark):
    """A page that a third of all URLs hang below is still one hop."""
    edges = spark.range(3000).select(
        F.concat(F.lit("http://n/"), "id").alias("child"),
        F.when(F.col("id") % 3 == 0, "http://hub/").otherwise(F.concat(F.lit("http://m/"), "id")).alias("parent"),
    )
    seeds = spark.createDataFrame([(0, "http://hub/")], "pos bigint, url string")
    assert G.seed_ancestors(edges, seeds).count() == 1000
