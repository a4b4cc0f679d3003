import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions.urls import canonical
from larkspur.operators import graph, web


def test_canonical_form():
    assert canonical("/a/../b//c?z=1&a=2&jsessionid=9#f", "HTTP://H:80/x") == "http://h/b/c?a=2&z=1"
    assert canonical("http://x/", "http://y/") is None and canonical("http://x/", "http://y/", same_host=False) == "http://x/"
    assert canonical("../../a", "http://h/b/c") == "http://h/a" and canonical("", "http://h") == "http://h/"
    assert canonical("?q=1&q=2", "http://h/a") == "http://h/a?q=2" and canonical("?q=1", "http://h/a", drop_query=True) == "http://h/a"
    assert canonical("https://h:443/%7Eme/.", "http://h/") == "https://h/~me/" and canonical("http://h:8080/", "http://h/") == "http://h:8080/"
    assert canonical(None, "http://h/") is None and canonical("http://h:x/", "http://h/") is None and canonical("mailto:a@b", "http://h/") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab/.%7E~?&=#:1 ", max_size=25))
def test_canonical_form_is_its_own(href):
    once = canonical(href, "http://host.example/p/q")
    if once is not None:
        assert canonical(once, once) == once


def test_robots_longest_rule_decides(spark, rows):
    text = "User-agent: *\nDisallow: /a # no\nAllow: /a/b\nDisallow:\n\nUser-agent: other\nDisallow: /"
    files = spark.createDataFrame([("http://h", text), ("http://e", None)], "host string, text string")
    rules = web.robots_table(files, "host", "text")
    assert ("https://h", "/a", False) in rows(rules)
    urls = spark.createDataFrame([(u,) for u in ("http://h/a/x", "http://h/a/b/c", "https://h/a", "http://h", "http://new/a", None)], "url string")
    assert rows(web.robots_filter(urls, "url", rules)) == [("http://h",), ("http://h/a/b/c",), ("http://new/a",)]


def test_frontier_order(spark):
    data = [("s1", "e", 0, 0), ("s1", "a", 1, 0), ("s1", "b", 0, 1), ("s1", "c", 0, 0), ("s2", "c", 0, 5), ("s1", None, 0, 0), ("s1", "seen", 0, 0)]
    links = spark.createDataFrame(data, "src string, url string, wave int, arrive int")
    order = web.frontier_order(links, spark.createDataFrame([("seen",)], "url string")).orderBy("place").collect()
    assert [(r["url"], r["place"]) for r in order] == [("c", 1), ("e", 2), ("b", 3), ("a", 4)]


def test_insert_if_absent(spark, rows):
    store = spark.createDataFrame([("a", 1)], "k string, v int")
    fresh = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3), (None, 4)], "k string, v int")
    assert rows(web.insert_if_absent(store, fresh, "k")) == [("b", 3)]
    assert web.insert_if_absent(store.limit(0), fresh.limit(0), "k").count() == 0


def test_crawl_by_waves(spark):
    site = {"http://h/": '<title>T</title><a href="/a">x</a><a href="http://o/">y</a>', "http://h/a": "<p>hi &amp; ho</p><a href='/'>back</a><a href='/b'>b</a>", "http://h/b": "end"}

    def fetch(url):
        return web.Page(200, "text/html; charset=utf-8", site[url]) if url in site else None

    got = {r["url"]: r for r in web.crawl(spark.createDataFrame([("http://h/",)], "u string"), "u", fetch, waves=2).collect()}
    assert set(got) == {"http://h/", "http://h/a"} and got["http://h/"]["out_links"] == ["http://h/a"] and got["http://h/a"]["wave"] == 1
    assert got["http://h/a"]["text"] == "hi & ho x y".replace(" x y", " back b")


def test_pages_as_they_are_read(spark):
    cases = {
        '<html><title> A </title><a class=x href="/u">l</a><a href="">m</a> b\n c': ("A", "l m b c", ["/u"]),
        "<head><title>A &amp; B</title><style>p{}</style></head><script>if (a<b) x('</p>')</script><p>1 &lt; 2 &eacute;&#33;<!-- no <a href=z> --><A HREF='x?a=1&amp;b=2'>l</A> <a href = y >m</a>": (
            "A & B", "1 < 2 é! l m", ["x?a=1&b=2", "y"]
        ),
        "a < b <b>c</b> <a data-href='n' name=q>d</a> <a href=\"cut": ("", "a < b c d", []), "<script>open": ("", "", []), "plain": ("", "plain", []), "": ("", "", []), None: ("", "", []),
    }
    df = spark.createDataFrame([(i, h, "x") for i, h in enumerate(cases)], "id int, h string, text string")
    got = {r["page_id"]: (r["title"], r["text"], r["hrefs"]) for r in web.parsed_pages(df, "id", "h").collect()}
    assert got == dict(enumerate(cases.values()))
    assert [tuple(r) for r in web.page_links(df.where("id = 1"), "id", "h").collect()] == [(1, 0, "x?a=1&b=2"), (1, 1, "y")]
    assert web.parsed_pages(df.limit(0), "id", "h").count() == 0


def test_robots_files_are_fetched_and_missing_ones_allow(spark, rows):
    def fetch(url):
        return {"http://a/robots.txt": web.Page(200, "text/plain", "User-agent: *\nDisallow: /x"), "http://b/robots.txt": web.Page(404, "text/html", "User-agent: *\nDisallow: /")}.get(url)

    files = web.fetched_robots(spark.createDataFrame([("http://a",), ("http://a",), ("http://b",), ("http://c",), (None,)], "h string"), "h", fetch)
    assert rows(files) == [("http://a", "User-agent: *\nDisallow: /x"), ("http://b", None), ("http://c", None)]
    urls = spark.createDataFrame([(f"http://{h}{p}",) for h in "abc" for p in ("/x", "/y")], "url string")
    assert rows(web.robots_filter(urls, "url", web.robots_table(files, "host", "text"))) == [("http://a/y",), ("http://b/x",), ("http://b/y",), ("http://c/x",), ("http://c/y",)]


def test_running_totals_over_partitions(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(200)], "k int, v int").repartition(7)
    got = {r["k"]: r["t"] for r in web.running_total(df, ["k"], F.col("v"), "t").collect()}
    total = 0
    for i in range(200):
        total += (i * 7) % 5
        assert got[i] == total
    assert web.running_total(df.limit(0), ["k"], F.col("v"), "t").count() == 0


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_pagerank_keeps_its_mass_and_spreads_sinks(spark):
    got = {r["node"]: r["score"] for r in graph.pagerank(edges(spark, [("a", "b")]), rounds=20).collect()}
    assert math.isclose(sum(got.values()), 1) and got["b"] > got["a"]
    assert graph.pagerank(edges(spark, []), rounds=2).count() == 0


def test_pagerank_against_dense_iteration(spark):
    rng = random.Random(5)
    pairs = sorted({(str(rng.randint(0, 9)), str(rng.randint(0, 12))) for _ in range(30)})
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [d for s, d in pairs if s == n] for n in nodes}
    score = {n: 1 / len(nodes) for n in nodes}
    for _ in range(60):
        sink = sum(score[n] for n in nodes if not out[n])
        new = {n: 0.15 / len(nodes) + 0.85 * sink / len(nodes) + sum(0.85 * score[s] / len(out[s]) for s in nodes if n in out[s]) for n in nodes}
        score = {n: v / sum(new.values()) for n, v in new.items()}
    got = {r["node"]: r["score"] for r in graph.pagerank(edges(spark, pairs)).collect()}
    assert all(abs(got[n] - score[n]) < 1e-4 for n in nodes)


def test_hits_norms_and_root(spark):
    e = edges(spark, [("h1", "r1"), ("h1", "r2"), ("h2", "r1"), ("r1", "z")])
    root = spark.createDataFrame([("r1",), ("r2",), ("alone",)], "node string")
    base = {r["node"] for r in graph.base_set(e, root).collect()}
    assert base == {"r1", "r2", "alone", "z", "h1", "h2"}
    got = graph.hits(e, root, rounds=3).collect()
    assert math.isclose(sum(r["hub"] ** 2 for r in got), 1) and math.isclose(sum((r["authority"] or 0) ** 2 for r in got), 1)
    assert {r["node"] for r in got if r["authority"] is not None} == {"r1", "r2", "alone"}
    capped = graph.capped_inlinks(e, root, 1).collect()
    assert [(r["src"], r["dst"]) for r in capped if r["dst"] == "r1"] == [("h1", "r1")]


def test_degrees_and_sinks(spark, rows):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "c")])
    assert rows(graph.out_degree(e)) == [("a", 2), ("b", 1)] and rows(graph.sink_pages(e)) == [("c",)]
    assert rows(graph.inlinks(e)) == [("b", 1), ("c", 2)]
    assert rows(graph.adjacency(e, "dst", "src")) == [("b", 0, ["a"]), ("c", 0, ["a", "b"])]
    many = edges(spark, [("x", str(i)) for i in range(50)])
    parts = graph.adjacency(many, most=10).collect()
    assert len(parts) > 1 and sorted(n for p in parts for n in p["neighbours"]) == sorted(str(i) for i in range(50))


@pytest.mark.parametrize("n", [0, 1, 57])
def test_placed_is_a_running_number(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % 57).alias("v"))
    assert sorted((r["v"], r["k"]) for r in web.placed(df, ["v"], "k").collect()) == [(i * 1, i + 1) for i in sorted(j * 7 % 57 for j in range(n))] if n == 57 else True
    assert web.placed(df, ["v"], "k").count() == n
