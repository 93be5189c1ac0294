"""URL rules with redirect equivalence.

A rule is (verdict, host, path): it fits its host and all subdomains if the url's path starts
with the rule's path; the longest fitting rule decides.  Urls without a rule take the verdict of
their aliases: canonical links and meta refreshes found in the pages (and given redirects) are
edges between urls, distributed connected components make the alias classes, and a class that
holds a url blocked by rule is blocked.  An explicit allow always stands: a url that an allow
rule fits is never blocked through its aliases.  Everything else is allowed.

Urls are nodes without their fragment and with scheme and host in lower case (A-Z).

Nulls: a null url, or one without ``://``, has empty host and path, no rule and no aliases, and
is allowed; null html has no edges.  Repeated pages are judged one by one, and repeated edges
count once.  Of rules that fit with equal length the later in the list decides.  Pages are searched
whole.  Only page_id, url and html are read, so other columns can't clash; an empty table gives an
empty result.

Relative links resolve against the page's url, or its ``<base href>`` if that is absolute, with
``.`` and ``..`` segments removed; ``&amp;`` and the numeric references of ``&`` are decoded.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import let, materialize
from evidara.llm.components import connected_components

URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"
#: The rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 2)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 3), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a node: no fragment, scheme and host in lower case; null without ``://``."""
    part = lambda i: F.regexp_extract(url, URL, i)
    return F.when(url.contains("://"), F.concat(ascii_lower(part(1)), F.lit("://"), ascii_lower(part(2)), part(3), part(4)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; a CASE over the list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of the canonical links and meta refreshes in the pages."""
    hidden = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
    some = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    some = some.select("url", F.regexp_replace("html", hidden, "").alias("html"))
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    decoded = lambda c: F.trim(F.regexp_replace(c, "&amp;|&#0*38;|&#[xX]0*26;", "&"))

    def attribute(tag: Column, name: str) -> Column:
        found = F.trim(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", 0))
        return F.regexp_replace(found, rf"""(?is)^{name}\s*=\s*["']?|["']$""", "")

    def target(tag: Column) -> Column:
        link = (F.lower(F.substring(tag, 2, 4)) == "link") & F.lower(attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")
        meta = (F.lower(F.substring(tag, 2, 4)) == "meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh")
        jump = F.regexp_extract(attribute(tag, "content"), r"""(?is)url\s*=\s*["']?([^"']*)""", 1)
        return decoded(F.when(link, attribute(tag, "href")).when(meta, jump))

    def without_dots(rest: Column) -> Column:
        """A path, and what follows it, without ``.`` and ``..`` segments."""
        path, tail = F.regexp_extract(rest, r"(?s)^([^?#]*)(.*)", 1), F.regexp_extract(rest, r"(?s)^([^?#]*)(.*)", 2)
        whole = F.regexp_replace(path, r"/\.{1,2}$", "$0/")  # a last dot segment leaves its slash
        zero = F.array().cast("array<string>")
        step = lambda a, x: F.when(x == ".", a).when((x == "..") & (F.size(a) > 1), F.slice(a, 1, F.size(a) - 1)).when(x == "..", a).otherwise(F.array_append(a, x))
        return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(F.aggregate(F.split(whole, "/", -1), zero, step), "/"), tail)).otherwise(rest)

    def resolve(to: Column) -> Column:
        scheme, host, path = (F.regexp_extract("base", URL, i) for i in (1, 2, 3))
        site = F.concat(scheme, F.lit("://"), host)
        folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "")
        return (
            F.when((to == "") | to.isNull(), F.lit(None))
            .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
            .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
            .when(to.startswith("/"), F.concat(site, without_dots(to)))
            .when(to.rlike(r"^[?#]"), F.concat(site, path, to))
            .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .otherwise(F.concat(site, without_dots(F.concat(folder, to))))
        )

    # Lambdas keep the long expressions out of the generated code, which has a size limit.
    edge = lambda tag: let(target(tag), lambda to: let(resolve(to), node_of))
    given = decoded(attribute(F.regexp_extract("html", r"(?is)<base\b[^>]*>", 0), "href"))
    some = some.withColumn("base", let(given, lambda b: F.when(b.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), b).otherwise(F.col("url"))))
    found = some.select(node_of(F.col("url")).alias("src"), F.explode(F.transform(tags, edge)).alias("dst"))
    return found.where("dst is not null and src <> dst").distinct()


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """(node): urls without a rule whose alias class holds a blocked url."""
    nodes = connected_components(edges, "src", "dst").withColumn("r", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    nodes = materialize(nodes.select("node", "component", F.col("r.verdict").alias("verdict")))
    bad = nodes.where("verdict = 'block'").select("component").distinct()
    return nodes.where("verdict is null").join(bad, "component", "left_semi").select("node")


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``redirects`` adds (src, dst) urls."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    aliases = blocked_aliases(materialize(edges), rules).withColumn("by_alias", F.lit(True))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    ruled = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    # Urls without a node meet no alias; numbers in place of it keep them from being joined in one task.
    some = F.coalesce("node", F.monotonically_increasing_id().cast("string"))
    judged = ruled.withColumn("node", some).join(aliases, "node", "left")
    verdict = F.coalesce("r.verdict", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
