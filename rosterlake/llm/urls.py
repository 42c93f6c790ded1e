"""URL filters with redirect equivalence.

A rule names a host and a path prefix and allows or blocks; it fits its host and all subdomains, and the longest
rule that fits decides.  URLs that no rule fits take the decision of their aliases: redirects (``<meta
http-equiv=refresh>``, or rows of a redirect table) and canonical links join URLs into components, found by
distributed connected components.  A component with a blocked member is blocked, unless a rule explicitly allows a
member: explicit allows go before inherited blocks.  Without either, a URL is allowed.
"""

import html
import re
from collections import namedtuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import in_arrow
from .components import components

Rule = namedtuple("Rule", "verdict host path")
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; without ``://`` empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _fits(rule, host, path):
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest fitting rule, both null without one."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = _fits(rule, host, path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path; distinct) with rule and own (its verdict) by a table of rules (verdict, host, path) of any size.

    Every host is joined by its suffixes with the rules' hosts, and its path's prefixes of the lengths that occur there
    with the rules' paths: rows follow the URLs and the lengths, not the rules.  Of equal rules an allow goes first.
    """
    rules = rules.select(F.col("verdict"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).filter(
        "verdict is not null and rule_host is not null and rule_path is not null")
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = (urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(lengths, "rule_host")
             .select("host", "path", "rule_host", F.explode("lengths").alias("n")).filter(F.length("path") >= F.col("n"))
             .select("host", "path", "rule_host", F.expr("left(path, n)").alias("rule_path")))
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), "rule_host", "rule_path", (F.col("verdict") == "allow").alias("a"),
                     "verdict")
    best = asked.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(order).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.verdict").alias("own"))


def _with_rule(df: DataFrame, rules) -> DataFrame:
    """``df`` (host, path, ...) with rule and own; ``rules`` is a short list, part of the plan, or a table."""
    if isinstance(rules, DataFrame):
        return df.join(ruled(df.select("host", "path").distinct(), rules), ["host", "path"], "left")
    rule, own = rule_columns(F.col("host"), F.col("path"), rules)
    return df.withColumns({"rule": rule, "own": own})


_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


def resolved(target: str, base: str):
    """An absolute URL of a link target found in the page ``base``, character references decoded; None without one."""
    target = html.unescape(target)
    if _SCHEME.match(target):
        return target
    try:
        joined = urljoin(base, target)
    except ValueError:
        return None
    return joined if _SCHEME.match(joined) else None


def _resolved(batches):
    for batch in batches:
        targets = [resolved(t, u) for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(targets, pa.string()), batch.column(2)], names=["url", "target", "kind"])


# percent-escapes of letters, digits and ``-._~``, which mean the same as the characters themselves
UNRESERVED = "^(2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])"


def _unescaped(rest: Column) -> Column:
    """A path and query with unreserved characters plain and other escapes in upper case."""
    def one(part):
        code = F.upper(F.substring(part, 1, 2))
        after = F.substr(part, F.lit(3))
        return (F.when(code.rlike(UNRESERVED), F.concat(F.decode(F.unhex(code), "UTF-8"), after))
                .when(code.rlike("^[0-9A-F]{2}"), F.concat(F.lit("%"), code, after)).otherwise(F.concat(F.lit("%"), part)))
    parts = F.split(rest, "%", -1)
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))
    return F.when(rest.contains("%"), joined).otherwise(rest)


def node_of(url: Column) -> Column:
    """Key of a URL in the alias graph.

    Scheme, fragment, default ports, escapes of unreserved characters and letters of the host do not tell URLs apart,
    and an empty path is ``/``.
    """
    host = F.regexp_replace(host_of(url), ":(80|443)?$", "")
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host, F.when(rest.startswith("/"), F.lit("")).otherwise("/"), _unescaped(rest)))


# one tag that is closed in the page; the attributes stand in either order
CANONICAL = (r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?canonical\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""",
             r"""(?is)<link\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*?\brel\s*=\s*["']?canonical\b""")
REFRESH = (r"""(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*?\burl\s*=\s*["']?((?:&#?\w+;|[^"'\s>;])+)""",)


def alias_edges(pages: DataFrame) -> DataFrame:
    """url, target, kind of the canonical links and refresh redirects in ``html``; pages without either give none."""
    page = F.col("html")
    low = F.lower(F.coalesce(page, F.lit("")))
    found = pages.select("url", page, low.alias("low")).filter("url is not null and (low like '%canonical%' or low like '%refresh%')")

    def first(patterns):
        tries = [F.regexp_extract(page, p, 1) for p in patterns]
        return F.coalesce(*[F.when(t != "", t) for t in tries])
    links = found.select("url", F.explode(F.array(
        F.struct(first(CANONICAL).alias("target"), F.lit("canonical").alias("kind")),
        F.struct(first(REFRESH).alias("target"), F.lit("redirect").alias("kind")))).alias("link"))
    links = links.select("url", "link.target", "link.kind").filter("target is not null")
    return links.transform(in_arrow, _resolved, "url string, target string, kind string").filter("target is not null")


def filtered(pages: DataFrame, rules=RULES, redirects: DataFrame = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component; one row per row of ``pages``.

    ``rules`` is a list of ``Rule`` or a table (verdict, host, path).  ``redirects`` (url, target) adds edges that are not in the pages.  URLs of edges need not be pages; rules hold for
    them too.  Null URL or one without ``://``: empty host and path, no rule, allowed, component null.  Repeated rows
    get equal results; an empty table gives an empty one; other columns are ignored.
    """
    url = F.col("url")
    edges = alias_edges(pages).select("url", "target")
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = edges.select(node_of(url).alias("u"), node_of(F.col("target")).alias("v"), url, F.col("target"))
    edges = materialise(edges.filter("u is not null and v is not null"), "aliases")
    merged = components(edges, "u", "v")
    ends = edges.select(F.col("u").alias("node"), "url").union(edges.select("v", "target")).distinct()
    decided = _with_rule(ends.select("node", host_of(url).alias("host"), path_of(url).alias("path")), rules).select("node", "own")
    # two counters per component, summed map-side: a huge component is one row here
    inherited = (merged.join(decided, "node").groupBy("component")
                 .agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"),
                      F.max((F.col("own") == "block").cast("int")).alias("blocked")))
    known = merged.join(inherited, "component").select(
        F.col("node"), "component", F.when(F.coalesce("allowed", F.lit(0)) == 1, "allow")
        .when(F.coalesce("blocked", F.lit(0)) == 1, "block").alias("passed"))
    host, path = host_of(url), path_of(url)
    rows = _with_rule(pages.select("page_id", host.alias("host"), path.alias("path"), node_of(url).alias("node")), rules)
    return rows.join(known, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict"), "component")
