"""Registry views: one catalogue of named predicates, evaluated in one pass."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands
from ..functions.arrays import explode_rows
from . import classify, ranking

GROUP_ORDER = ("MCP", "AI", "Data", "Other", "Security")


class Section(NamedTuple):
    key: str
    title: str
    predicate: object  # None marks the catch-all


class View(NamedTuple):
    slug: str
    group: str
    predicate: Column
    sections: tuple


def _cls(*labels) -> Column:
    return F.col("primary_class").isin(*labels)


def catalogue(prefix="taiwan", strict_verified=False) -> tuple:
    """The ten views.  Predicates read primary_class, identity_status,
    region_level and security_status.

    A verified server stays in the verified view after promotion;
    ``strict_verified=True`` admits RUNTIME_VERIFIED only.
    """
    relevant = bands.at_least_level(F.col("region_level"))
    listable = F.col("security_status") != "BLOCKED"
    proven = ("RUNTIME_VERIFIED",) if strict_verified else ("RUNTIME_VERIFIED", "VERIFIED")
    server = _cls("MCP_SERVER")
    data = _cls("AI_DATASET", "AI_KNOWLEDGE_BASE", "AI_API") & relevant
    primary = F.col("primary_class")
    one = lambda key, title: (Section(key, title, None),)
    v = lambda suffix, group, predicate, sections: View(f"{prefix}-{suffix}", group, predicate, sections)
    return (
        v("ai-ecosystem", "Other", relevant, (
            Section("mcp", "MCP Servers & Tools", classify.is_protocol_class(primary)),
            Section("ai", "AI Agents & Models", classify.is_ai_class(primary)),
            Section("data", "Data & Datasets", data),
            Section("other", "Other", None))),
        v("mcp", "MCP", server & F.col("identity_status").isin(*proven) & relevant & listable,
          one("verified", "Verified MCP Servers")),
        v("mcp-candidates", "MCP", server & F.col("identity_status").isin("CANDIDATE", "STATIC_VERIFIED"),
          one("candidates", "MCP Server Candidates")),
        v("ai-agents", "AI", _cls("AI_AGENT") & relevant, one("agents", "AI Agents")),
        v("ai-tools", "AI", _cls("AI_TOOL", "AI_SDK", "AI_FRAMEWORK", "AI_PLUGIN") & relevant,
          one("tools", "AI Tools")),
        v("ai-data", "Data", data, one("data", "AI Data Sources")),
        v("ai-skills", "AI", _cls("AI_SKILL", "MCP_SKILL"), one("skills", "AI Skills")),
        v("ai-infrastructure", "AI", _cls("AI_INFRASTRUCTURE"), one("infra", "Infrastructure")),
        v("ai-tutorials", "Other", _cls("AI_TUTORIAL", "AI_EXAMPLE"), one("tutorials", "Tutorials")),
        v("ai-collections", "Other", _cls("AI_COLLECTION", "AI_REGISTRY", "MCP_COLLECTION"),
          one("collections", "Collections")),
    )


def flags(df: DataFrame, views=None) -> DataFrame:
    """One boolean column per view."""
    views = views or catalogue()
    return df.withColumns({v.slug.replace("-", "_"): F.coalesce(v.predicate, F.lit(False)) for v in views})


def counts(df: DataFrame, views=None) -> DataFrame:
    """Rows per view in a single pass; views without rows count 0."""
    views = views or catalogue()
    wide = df.agg(*[F.count_if(v.predicate).alias(f"c{i}") for i, v in enumerate(views)])
    rows = F.array(*[F.struct(
        F.lit(i + 1).alias("position"), F.lit(v.slug).alias("view"), F.lit(v.group).alias("view_group"),
        F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("entities")) for i, v in enumerate(views)])
    return wide.select(F.inline(rows))


def index(df: DataFrame, views=None) -> DataFrame:
    """Counts in the fixed order of view groups."""
    order = F.create_map(*[F.lit(x) for i, g in enumerate(GROUP_ORDER) for x in (g, i)])
    return (counts(df, views).withColumn("group_order", F.element_at(order, F.col("view_group")) + 1)
            .orderBy("group_order", "position"))


def exclusive_section(sections) -> Column:
    """Key of the first matching section; unmatched rows go to the catch-all."""
    named = [(s.predicate, F.lit(s.key)) for s in sections if s.predicate is not None]
    rest = next((s.key for s in sections if s.predicate is None), None)
    return classify.first_true(named, rest) if named else F.lit(rest)


def members(df: DataFrame, view: View) -> DataFrame:
    return df.filter(view.predicate).withColumn("section", exclusive_section(view.sections))


def memberships(df: DataFrame, views=None, key="id") -> DataFrame:
    """Long (view, section, key) table for all views, one pass over the input."""
    views = views or catalogue()
    entries = F.array_compact(F.array(*[
        F.when(v.predicate, F.struct(F.lit(v.slug).alias("view"),
                                     exclusive_section(v.sections).alias("section"))) for v in views]))
    return explode_rows(df, key, entries, "_m").select(key, "_m.view", "_m.section")


def section_totals(df: DataFrame, view: View) -> DataFrame:
    """Rows per section of one view, empty sections included as 0."""
    tagged = members(df, view)
    wide = tagged.agg(*[F.count_if(F.col("section") == s.key).alias(s.key) for s in view.sections])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("section_order"), F.lit(s.key).alias("section"),
                              F.lit(s.title).alias("title"), F.col(s.key).alias("entities"))
                     for i, s in enumerate(view.sections)])
    return wide.select(F.inline(rows))


def report(df: DataFrame, view: View, columns=("id", "name", "quality_score", "region_level")) -> DataFrame:
    """Section, position, and the listed columns: quality desc, name, id."""
    cols = list(dict.fromkeys([*columns, "id", "name", "quality_score"]))
    rows = members(df, view).select("section", *cols)
    return ranking.positions(rows, "section", ("-quality_score", "name", "id"))


def verified_servers(df: DataFrame) -> DataFrame:
    return df.filter((F.col("primary_class") == "MCP_SERVER") & (F.col("identity_status") == "RUNTIME_VERIFIED"))


def server_candidates(df: DataFrame) -> DataFrame:
    return df.filter((F.col("primary_class") == "MCP_SERVER")
                     & F.col("identity_status").isin("CANDIDATE", "STATIC_VERIFIED"))


def legacy_status(entity_status: Column) -> Column:
    return (F.when(entity_status.isin("VERIFIED", "CANDIDATE"), "ACTIVE")
            .when(entity_status == "QUARANTINED", "DORMANT")
            .when(entity_status == "REJECTED", "ARCHIVED").otherwise("UNKNOWN"))


def server_view(df: DataFrame) -> DataFrame:
    """Back-compatible projection: runtime endpoints only, old status names."""
    runtime = F.filter("endpoints", lambda e: e["type"] == "MCP_RUNTIME_ENDPOINT")
    return (df.withColumn("_runtime", runtime).select(
        "id", "name", "slug", "description", F.array(F.lit("TW")).alias("region"),
        F.col("_runtime").alias("endpoints"),
        F.transform("_runtime", lambda e: e["transport"]).alias("transport"),
        "tools", "resources", "prompts", "data_sources", "license",
        legacy_status(F.col("entity_status")).alias("status"),
        "quality_score", "region_score", "region_level", "sources", "first_seen", "last_seen"))
