"""Endpoint collection, typing and verdicts."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import regex, sqltext as S, urls
from ..functions.arrays import computed_once, explode_rows
from ..rules import patterns


def collect(df: DataFrame, key="id") -> DataFrame:
    """One row per distinct URL of an entity, first origin wins.

    Origins in order: listed endpoints, repository, homepage, URLs in the
    content.  De-duplication happens inside the row, before the explode, so no
    shuffle is needed: each origin's distinct URLs, less those of earlier ones.
    """
    def tag(us, origin):
        return F.transform(us, lambda u: F.struct(u.alias("url"), F.lit(origin).alias("origin")))

    filled = lambda us: F.filter(us, lambda u: u != "")
    # the arrays are computed once, in place, before they are compared
    each = df.select(key, "homepage", _runtime_hinted(F.col("raw_content")).alias("runtime_hint"), F.explode_outer(F.array(F.struct(
        F.array_distinct(F.transform("endpoints", lambda e: e["url"])).alias("listed"),
        F.array_distinct(filled(F.array("repo_url", "homepage"))).alias("info"),
        F.array_distinct(filled(urls.embedded_urls(F.col("raw_content")))).alias("content")))).alias("_u"))
    listed = F.coalesce("_u.listed", F.array().cast("array<string>"))
    found = F.concat(
        tag(listed, "endpoint"), tag(F.array_except("_u.info", listed), "repository_info"),
        tag(F.array_except("_u.content", F.concat(listed, "_u.info")), "raw_content"))
    return (explode_rows(each, [key, "homepage", "runtime_hint"], found, "_e", "position")
            .select(key, "homepage", "runtime_hint", "position", "_e.url", "_e.origin"))


def _runtime_hinted(content: Column) -> Column:
    return regex.contains_any(F.lower(content), patterns.RUNTIME_HINTS)


def _looks_runtime(low: str) -> str:
    local = " OR ".join(f"startswith({low}, {S.quote(p)})" for p in patterns.RUNTIME_PREFIXES)
    return f"({local} OR (startswith({low}, 'https://') AND {S.any_of(low, patterns.RUNTIME_PATHS)}))"


def votes(url="url", homepage="homepage", runtime_hint="runtime_hint", rules=patterns.URL_RULES) -> Column:
    """array<struct<type, rule, confidence>> of every rule a URL satisfies; the
    arguments are column names or SQL expressions."""
    low = f"lower({url})"

    def vote(cond, kind, rule, conf):
        item = f"named_struct('type', {S.quote(kind)}, 'rule', {S.quote(rule)}, 'confidence', {S.num(conf)})"
        return f"IF({cond}, {item}, NULL)"

    cast = [vote(f"rlike({low}, {S.quote(regex.jvm(r.pattern))})", r.type, r.rule, r.confidence) for r in rules]
    cast.append(vote(f"{homepage} <> '' AND {low} = lower({homepage})", *patterns.HOMEPAGE_RULE))
    cast.append(vote(f"{runtime_hint} AND {_looks_runtime(low)}", *patterns.RUNTIME_RULE))
    return F.expr(f"array_compact(array({', '.join(cast)}))")


def decide(ballots: Column, kinds=None) -> Column:
    """Type with the largest confidence sum, capped at 1; UNKNOWN 0.1 when no
    rule fired.  Ties go to the type named first in ``kinds``."""
    kinds = kinds or tuple(dict.fromkeys(
        [r.type for r in patterns.URL_RULES] + [patterns.HOMEPAGE_RULE[0], patterns.RUNTIME_RULE[0]]))

    def total(kind):
        return F.round(F.aggregate(F.filter(ballots, lambda b: b["type"] == kind), F.lit(0.0),
                                   lambda acc, b: acc + b["confidence"]), 6)

    tally = F.array(*[F.struct(total(k).alias("sum"), F.lit(-i).alias("order"), F.lit(k).alias("type"))
                      for i, k in enumerate(kinds)])
    best = F.array_max(tally)
    return F.when(F.size(ballots) > 0, F.struct(
        best["type"].alias("type"), F.least(best["sum"], F.lit(1.0)).alias("confidence"))) \
        .otherwise(F.struct(F.lit("UNKNOWN").alias("type"), F.lit(0.1).alias("confidence")))


def classify(collected: DataFrame, rules=patterns.URL_RULES) -> DataFrame:
    """Typed long endpoint table: adds type, confidence and the winning rules."""
    return (collected
            .withColumn("_votes", votes(rules=rules))
            .withColumn("_best", decide(F.col("_votes")))
            .transform(computed_once, "_typed", F.struct(
                F.col("_best.type").alias("type"), F.col("_best.confidence").alias("confidence"),
                F.transform(F.filter("_votes", lambda v: v["type"] == F.col("_best.type")),
                            lambda v: v["rule"]).alias("rules")))
            .drop("_votes", "_best", "homepage", "runtime_hint").select("*", "_typed.*").drop("_typed"))


def runtime_override(typed: DataFrame, passed: DataFrame, key="id") -> DataFrame:
    """For entities whose handshake passed: the first runtime endpoint becomes
    certain; without one, the first listed endpoint is added as runtime.

    Both choices are per-key minima, combined before the shuffle.
    """
    is_runtime = F.col("type") == "MCP_RUNTIME_ENDPOINT"
    listed = F.col("origin") == "endpoint"
    firsts = (typed.join(passed.select(key).distinct(), key, "left_semi").groupBy(key).agg(
        F.min(F.when(is_runtime, F.col("position"))).alias("_runtime_at"),
        F.min(F.when(listed, F.col("position"))).alias("_listed_at")))
    marked = typed.join(firsts, key, "left")
    sure = marked.withColumn("confidence", F.when(
        F.col("position") == F.col("_runtime_at"), 1.0).otherwise(F.col("confidence")))
    extra = F.array(F.struct(F.lit(False).alias("added")), F.struct(F.lit(True).alias("added")))
    add_here = F.col("_runtime_at").isNull() & (F.col("position") == F.col("_listed_at"))
    out = sure.withColumn("_copy", F.explode(F.when(add_here, extra).otherwise(F.slice(extra, 1, 1))))
    added = F.col("_copy.added")
    return (out
            .withColumn("type", F.when(added, "MCP_RUNTIME_ENDPOINT").otherwise(F.col("type")))
            .withColumn("confidence", F.when(added, 1.0).otherwise(F.col("confidence")))
            .withColumn("rules", F.when(added, F.array(F.lit("runtime_verified"))).otherwise(F.col("rules")))
            .drop("_copy", "_runtime_at", "_listed_at"))


def runtime_endpoints(typed: DataFrame, floor=0.5) -> DataFrame:
    return typed.filter((F.col("type") == "MCP_RUNTIME_ENDPOINT") & (F.col("confidence") > floor))


# --- verdicts over landed probe results ------------------------------------------

def health(url: Column, http_status: Column, network_error: Column = None) -> Column:
    """200 healthy, 5xx or no answer unavailable, anything else degraded."""
    failed = F.lit(False) if network_error is None else F.coalesce(network_error, F.lit(False))
    return (F.when(F.coalesce(url, F.lit("")) == "", "UNKNOWN")
            .when(failed | http_status.isNull(), "UNAVAILABLE")
            .when(http_status == 200, "HEALTHY")
            .when(http_status >= 500, "UNAVAILABLE")
            .otherwise("DEGRADED"))


def worst_health(states: DataFrame, key: str, state="health") -> DataFrame:
    """Worst state per key as one integer maximum, decoded afterwards."""
    rank = (F.when(F.col(state) == "HEALTHY", 1).when(F.col(state) == "DEGRADED", 2)
            .when(F.col(state) == "UNAVAILABLE", 3).when(F.col(state) == "INVALID", 4).otherwise(5))
    names = F.array(*[F.lit(s) for s in ("HEALTHY", "DEGRADED", "UNAVAILABLE", "INVALID", "UNKNOWN")])
    return (states.groupBy(key).agg(F.max(rank).alias("_rank"))
            .select(key, F.element_at(names, F.col("_rank")).alias(state)))


def server_health(entities: DataFrame, states: DataFrame, key: str, state="health") -> DataFrame:
    """Worst state per entity; an entity without endpoints to probe is healthy."""
    return (entities.select(key).join(worst_health(states, key, state), key, "left")
            .withColumn(state, F.coalesce(state, F.lit("HEALTHY"))))


def repository_status(url: Column, archived: Column, http_status: Column, pushed_at: Column,
                      as_of: Column) -> Column:
    from ..functions import bands
    by_age = bands.activity(pushed_at, as_of)
    return (F.when(F.coalesce(url, F.lit("")) == "", "DELETED")
            .when(F.coalesce(archived, F.lit(False)), "ARCHIVED")
            .when(http_status.isin(404, 410), "DELETED")
            .when(pushed_at.isNotNull(), by_age)
            .when(http_status == 200, "ACTIVE")
            .otherwise("UNKNOWN"))


def transport_findings(df: DataFrame, key="id") -> DataFrame:
    """Plain-http and local-address findings per listed endpoint."""
    exploded = df.select(key, F.explode(F.transform("endpoints", lambda e: e["url"])).alias("url"))
    low = F.lower("url")

    def finding(kind, rule, conf):
        return F.struct(F.lit(kind).alias("type"), F.lit("MEDIUM").alias("severity"),
                        F.lit(rule).alias("rule"), F.lit(conf).alias("confidence"))

    plain = F.when(F.startswith("url", F.lit("http://")),
                   finding("insecure_transport", "http_url_pattern", 0.9))
    local = F.when(regex.contains_any(low, patterns.LOCAL_ADDRESS_MARKS),
                   finding("localhost_exposure", "localhost_exposed_pattern", 0.85))
    return (explode_rows(exploded, [key, "url"], F.array_compact(F.array(plain, local)), "f")
            .select(key, "f.type", "f.severity", "f.rule", F.lit("endpoint").alias("source"),
                    F.col("url").alias("location"), F.col("url").alias("evidence"),
                    F.col("f.confidence").alias("confidence")))
