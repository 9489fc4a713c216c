import random

from pyspark.sql import functions as F

from casewise.llm import url_filter as U
from casewise.llm.common import Scratch
from casewise.llm.components import connected_components


def verdicts(spark, urls, edges=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    links = spark.createDataFrame(list(edges), "a string, b string")
    rows = U.judge_urls(pages, U.rule_table(spark, U.RULES), links).orderBy("page_id").collect()
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]


def test_rules_and_parts(spark):
    got = verdicts(
        spark,
        ["http://WWW.Example.com/en/x?q#f", "https://a.example.com/en/", "https://b.net/es/1", "https://b.net/es", "ftp://com", None, "no scheme", "://x.com/y", ""],
    )
    assert got == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/", "example.com/en/", "block"),
        ("b.net", "/es/1", "net/es/", "block"),
        ("b.net", "/es", None, "allow"),
        ("com", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("x.com", "/y", "com/", "allow"),
        ("", "", None, "allow"),
    ]


def test_blocks_follow_links_and_allows_come_first(spark):
    urls = ["https://a.org/1", "https://a.org/2", "https://b.org/1", "https://c.org/1", "http://a.org/1/#top"]
    edges = [("https://a.org/1", "https://a.org/2"), ("https://a.org/2", "https://x.net/es/9"), ("https://b.org/1", "https://x.net/fr/1"),
             ("https://b.org/1", "https://y.com/ok"), ("https://c.org/1", None)]
    got = [v for *_, v in verdicts(spark, urls, edges)]
    assert got == ["block", "block", "allow", "allow", "block"]


def test_declared_links(spark):
    html = ["<link rel='canonical' href='/c'>", '<META HTTP-EQUIV="refresh" content="0; url=https://b.net/es/1">', "<p>", None, "<link rel=canonical href=//x/y>"]
    pages = spark.createDataFrame([(f"https://a.org/{i}", h) for i, h in enumerate(html)], "url string, html string")
    got = {(r["a"], r["b"]) for r in U.link_edges(pages).collect()}
    assert got == {("https://a.org/0", "https://a.org/c"), ("https://a.org/1", "https://b.net/es/1")}


def test_empty_repeated_and_clashing(spark):
    schema = "page_id long, url string, component string, node string, verdict string"
    rules = U.rule_table(spark, U.RULES)
    none = spark.createDataFrame([], "a string, b string")
    assert U.judge_urls(spark.createDataFrame([], schema), rules, none).collect() == []
    rows = [(1, "https://q.net/fr/1", "c", "n", "v")] * 3
    got = U.judge_urls(spark.createDataFrame(rows, schema), rules, none).collect()
    assert len(got) == 3 and {(r["component"], r["node"], r["verdict"]) for r in got} == {("c", "n", "block")}


def test_components_of_a_random_graph(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    edges += [(900, n) for n in range(700, 760)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(df.where(F.lit(False)), Scratch(spark, "test")).collect() == []
