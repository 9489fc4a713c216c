"""URL rules whose decisions follow redirects: blocks spread to aliases, explicit allows come first.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import LOWER, UPPER, Scratch, table
from casewise.llm.components import connected_components


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def implied_target(url: Column) -> Column:
    """Where a server would send a variant of an address: https, host in lower case, no fragment,
    no tracking parameters, no slash at the end of the path."""
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))
    kept = F.array_join(kept, "&")
    path = F.regexp_replace(path_of(url), "/+$", "")
    whole = F.concat(F.lit("https://"), host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url.rlike("^(?i:https?)://[^/?#]"), whole)


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): redirects and canonical links that ``pages`` (url, html) declare or imply.

    Declared: the page's ``<link rel=canonical>`` and its refresh target. A target without ``://`` is
    read from the root of the page's host when it starts with ``/``, else ignored.
    """
    html = F.col("html")
    link = F.regexp_extract(html, r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract(html, r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    declared = F.array(
        F.regexp_extract(link, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
        F.regexp_extract(refresh, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    root = F.regexp_extract("url", "^(?s:.*?)://[^/?#]*", 0)
    targets = F.transform(
        declared,
        lambda t: F.when(t.contains("://"), t).when(t.startswith("/") & ~t.startswith("//"), F.concat(root, t)),
    )
    found = pages.select(F.col("url").alias("a"), F.explode(targets).alias("b")).where("b IS NOT NULL")
    return found.where(F.col("a").contains("://"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table; ``verdict`` is ``allow`` or ``block``."""
    return spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict): the longest fitting rule of each distinct ``url``; urls without one have no row.

    Each host is looked up under itself and its parent domains, so the rules are joined by key, at any
    number. Of equally long rules an allow wins, then the smaller string.
    """
    labels = F.split(host_of(F.col("url")), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda at: F.array_join(F.slice(labels, at, F.size(labels)), ".")
    )
    asked = urls.select("url", path_of(F.col("url")).alias("path"), F.explode(parents).alias("rule_host"))
    fits = asked.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(rule.alias("rule"), F.col("rule_verdict").alias("verdict")),
                    F.struct(F.length(rule), F.col("rule_verdict") == "allow", rule))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``pages`` need ``url``; ``edges`` (a, b) are redirects and canonical links, by default those that
    the pages' ``html`` declares, together with the implied ones. A rule that fits an url decides it.
    For others the connected component of the redirect graph does: if the component holds an
    explicitly allowed address, allow; else if it holds a blocked one, block; else allow. An address
    that is only a target of a link counts as a member. Null urls, and urls without ``://``, have empty host and
    path, fit no rule, are in no component and are allowed. Repeated pages keep their rows, columns
    of the input are kept except those four, and an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    if edges is None:
        edges = link_edges(pages)
    own = pages.select("url").where(F.col("url").contains("://")).distinct()
    links = scratch.save(edges.select("a", "b").distinct(), "links")
    nodes = scratch.save(own.union(links.select("a")).union(links.select("b")).distinct(), "nodes")
    implied = nodes.select(F.col("url").alias("a"), implied_target(F.col("url")).alias("b"))
    groups = connected_components(links.union(implied), scratch)
    fitting = scratch.save(match_rules(nodes, rules), "rules")
    member = groups.join(fitting, groups["node"] == fitting["url"])
    decided = member.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"))
    decided = scratch.save(decided.where("NOT allowed").select("component"), "decided")  # blocked, and nothing in it allowed
    spread = groups.join(decided, "component").select(F.col("node").alias("url"), F.lit("block").alias("spread"))
    verdicts = nodes.join(fitting, "url", "left").join(spread, "url", "left")
    verdicts = verdicts.select("url", "rule", F.coalesce("verdict", "spread").alias("verdict")).where("verdict IS NOT NULL")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "url")
    judged = rows.join(scratch.save(verdicts, "verdicts"), "url", "left")
    return judged.select(
        "row.*",
        host_of(F.col("row.url")).alias("host"),
        path_of(F.col("row.url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


# The rules of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op2_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    edges = link_edges(pages)
    judged = judge_urls(pages.drop("html"), rule_table(spark, RULES), edges)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
links AS (
    SELECT url AS a, regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
        '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM pages
    UNION SELECT url, regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
        '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM pages
),
declared AS (
    SELECT a, CASE WHEN contains(b, '://') THEN b
        WHEN starts_with(b, '/') AND NOT starts_with(b, '//') THEN regexp_extract(a, '^(?s:.*?)://[^/?#]*') || b END AS b
    FROM links WHERE contains(a, '://')
),
nodes AS (SELECT url FROM pages WHERE contains(url, '://') UNION SELECT a FROM declared WHERE b IS NOT NULL
    UNION SELECT b FROM declared WHERE b IS NOT NULL),
parts AS (
    SELECT url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
        array_to_string(list_filter(string_split(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')), '&') AS kept
    FROM nodes
),
edges AS (
    SELECT a, b FROM declared WHERE b IS NOT NULL
    UNION SELECT url, 'https://' || host || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END
    FROM parts WHERE regexp_matches(url, '^(?i:https?)://[^/?#]')
),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, t.b FROM reach r JOIN ways t ON r.b = t.a),
component AS (SELECT a AS url, least(a, min(b)) AS id FROM reach GROUP BY a),
fits AS (
    SELECT url, arg_max(r.host || r.path, (length(r.host || r.path), r.verdict = 'allow')) AS rule,
        arg_max(r.verdict, (length(r.host || r.path), r.verdict = 'allow')) AS verdict
    FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY url
),
spread AS (SELECT id FROM component JOIN fits USING (url) GROUP BY id HAVING NOT bool_or(verdict = 'allow'))
SELECT page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, rule,
    coalesce(verdict, CASE WHEN s.id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN parts p USING (url) LEFT JOIN fits USING (url) LEFT JOIN component USING (url) LEFT JOIN spread s USING (id)
"""
