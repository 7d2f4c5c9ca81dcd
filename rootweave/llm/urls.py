"""URL filters with redirect equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains and
the longest fitting rule wins.  Redirects (``<meta http-equiv=refresh>``) and
canonical links tie urls together: over these edges connected components are
found, and a block reaches every alias in a component unless one of the
component's urls is explicitly allowed.  A url's own rule always comes first.

Everything here is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules given as a list become one expression; more than this must come as a table.
MAX_INLINE_RULES = 256


#: Tags that tie a page to another url; every one of a page counts.
CANONICAL = r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, _, path = text.partition("/")
    return Rule(verdict, host, "/" + path)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """``(host, path, query)``; null or without ``://``: all empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return host, path, query


def alias_key(host: Column, path: Column, query: Column) -> Column:
    """What makes two spellings the same url: scheme, fragment and a final slash
    don't count.  Null for an empty host, which is an alias of nothing."""
    key = F.concat(host, F.regexp_replace(path, r"/+$", ""), query)
    return F.when(host != "", key)


def own_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, or null; of equally long
    ones the last by name."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def own_rule_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(host, path, ...)`` with ``own``, as ``own_rule`` gives it, for any number of
    ``rules(verdict, host, path)``; of repeated rules the last by verdict counts.

    A url is looked up under its host and every domain above it, and there under its
    path's beginnings of the lengths that the domain's rules have: equi-joins, so a host
    with many rules or many urls makes no pairs that don't fit."""
    rules = rules.where("verdict is not null and host is not null and path is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.col("host").alias("domain"), F.col("path").alias("start"), "verdict")
    lengths = rules.groupBy("domain").agg(F.collect_set(F.length("start")).alias("lengths"))
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.select("host", "path", F.explode(above).alias("domain")).join(lengths, "domain")
    asked = asked.select("host", "path", "domain", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    fits = asked.withColumn("start", F.substring(F.col("path"), F.lit(1), F.col("n"))).join(rules, ["domain", "start"])
    name = F.concat("domain", "start")
    longest = F.max_by(F.struct(name.alias("rule"), "verdict"), F.struct(F.length(name), name)).alias("own")
    return urls.join(fits.groupBy("host", "path").agg(longest), ["host", "path"], "left")


def with_rule(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """``urls`` with ``own``: rules that are few inline, others joined."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_INLINE_RULES:
            return urls.withColumn("own", own_rule(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    return own_rule_join(urls, rules)


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between alias keys with the targets' ``host`` and ``path``:
    all canonical links and meta refreshes of the html.  Relative targets are taken
    from the page's own host."""
    html = F.coalesce("html", F.lit(""))

    def targets(tag, attribute):
        tags = F.regexp_extract_all(html, F.lit(tag), F.lit(0))
        return F.transform(tags, lambda x: F.regexp_extract(x, attribute, 1))

    canonical = targets(CANONICAL, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = targets(REFRESH, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    tags = pages.where(html.rlike(r"(?i)\bcanonical\b|http-equiv")).select("url", F.explode(F.concat(canonical, refresh)).alias("to"))
    host, path, query = split_url(F.col("url"))
    tags = tags.where("to <> ''").select("to", host.alias("h"), path.alias("p"), alias_key(host, path, query).alias("a"))
    to = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&"))
    full = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(F.lit("http://"), F.col("h"), to))
        .otherwise(F.concat(F.lit("http://"), F.col("h"), F.regexp_replace("p", r"[^/]*$", ""), to))
    )
    host, path, query = split_url(F.col("full"))
    return (
        tags.withColumn("full", full)
        .select("a", alias_key(host, path, query).alias("b"), host.alias("host"), path.alias("path"))
        .where("a is not null and b is not null")
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Verdict of every row of ``pages(page_id, url, html)``, by a list of rules or a table
    ``(verdict, host, path)`` of any number.

    Returns ``page_id, host, path, rule, verdict, alias_of``: ``rule`` is the
    page's own longest rule or null, ``verdict`` is that rule's, else ``block`` if
    an alias is blocked and none is explicitly allowed, else ``allow``;
    ``alias_of`` is the least url key of the page's component, null outside one.
    Null, empty or malformed urls have empty host and path, fit no rule and are
    allowed.  Urls and pages of any length are read whole.  Repeated rows are judged
    each, an empty table gives no row, other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html")
    edges = link_edges(pages)
    found = connected_components(edges.select("a", "b"))
    host, path, query = split_url(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), alias_key(host, path, query).alias("key"))
    # every spelling of a node has a say: those of the links' ends and the pages' own
    ends = edges.select(F.col("b").alias("node"), "host", "path").union(own.where("key is not null").select("key", "host", "path"))
    seeds = with_rule(ends, rules).select("node", F.col("own.verdict").alias("v")).distinct()
    judged = found.join(seeds, "node").groupBy("component").agg(
        F.bool_or(F.col("v") == "block").alias("blocked"), F.bool_or(F.col("v") == "allow").alias("allowed")
    )
    aliases = found.join(judged, "component").select(
        F.col("node").alias("key"),
        F.col("component").alias("alias_of"),
        (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("inherited"),
    )
    own = with_rule(own, rules)
    return own.join(aliases, "key", "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(F.col("inherited"), F.lit("block")), F.lit("allow")).alias("verdict"),
        "alias_of",
    )
