"""Registry exports and report tables.

Reports are tables; whoever renders them needs no further aggregation.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls
from ..operators import categories, findings, ranking, views
from ..rules import vocab


def health(column="health") -> Column:
    return F.upper(F.coalesce(F.nullif(column, F.lit("")), F.lit("UNKNOWN")))


def registry_rows(df: DataFrame, *more: Column) -> DataFrame:
    """Full projection of the registry file, with further columns of the same rows."""
    return df.select(
        "id", "name", "description", F.col("categories").alias("category"),
        F.array(F.lit("TW")).alias("region"),
        F.struct(F.col("region_level").alias("level"), F.col("region_score").alias("score")).alias("taiwan_relevance"),
        (F.size("data_sources") > 0).alias("official_data_source"),
        F.struct(F.col("repo_url").alias("url"), "stars", "license").alias("repository"),
        "transport", "tools", F.struct(F.col("quality_score").alias("score")).alias("quality"),
        F.col("entity_status").alias("status"), *more)


def minimal_rows(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "description", F.col("categories").alias("category"), "transport")


def health_rows(df: DataFrame) -> DataFrame:
    return df.select("id", "name", health().alias("health"))


def write_json(df: DataFrame, path: str):
    """Distributed JSON lines; the file count follows the data size."""
    df.write.mode("overwrite").json(path)


def view_rows(df: DataFrame, catalogue=None, key="id") -> DataFrame:
    """Rows of every view with the view's name and size, ready for a write
    partitioned by view.  Sizes come from one small aggregate."""
    catalogue = catalogue or views.catalogue()
    sizes = views.counts(df, catalogue).select("view", F.col("entities").alias("total_entities"))
    rows = views.memberships(df, catalogue, key)
    return rows.join(sizes, "view")


def write_views(df: DataFrame, path: str, catalogue=None, key="id"):
    members = view_rows(df, catalogue, key).join(df, key)
    members.write.mode("overwrite").partitionBy("view").json(path)


def view_report(df: DataFrame, view: views.View) -> DataFrame:
    """Section, position, name, link, quality, level of one view."""
    linked = df.withColumn("url", urls.link_or_fallback(F.col("repo_url"), F.col("endpoints")))
    return views.report(linked, view, ("id", "name", "url", "quality_score", "region_level"))


def registry_report(df: DataFrame, shown=150) -> DataFrame:
    """Exclusive functional sections by region score, then international rows by
    name; every entity appears once.  ``summary`` is the description cut for display."""
    plain = T.strip_tags(F.col("description"))
    rows = df.select(
        "id", "name", plain.alias("description"), T.truncate(plain, shown).alias("summary"),
        "region_level", "region_score",
        F.when(F.col("region_level") == "T0", "international")
         .otherwise(categories.first_section(F.col("categories"))).alias("section"))
    # one ordering serves both kinds of section
    rows = rows.withColumn("_rank", F.when(F.col("section") == "international", 0.0)
                           .otherwise(-F.col("region_score")))
    order = F.create_map(*[F.lit(x) for i, s in enumerate(vocab.FUNCTIONAL_CATEGORIES + ("international",))
                           for x in (s, i + 1)])
    return ranking.positions(rows, "section", ("_rank", "name", "id")).drop("_rank") \
                  .withColumn("section_order", F.element_at(order, F.col("section")))


def compat_list(df: DataFrame, shown=150, shown_tool=100) -> DataFrame:
    """Runtime-verified servers, best first; ``summary`` and ``tool_lines`` are cut for display."""
    rows = views.verified_servers(df)
    return (rows.select(
        "id", "name", "description", T.truncate(F.col("description"), shown).alias("summary"), "repo_url", "license",
        "quality_score", "tools", F.transform("tools", lambda t: F.concat_ws(
            ": ", t["name"], T.truncate(t["description"], shown_tool))).alias("tool_lines"))
        .orderBy(F.desc("quality_score"), "id"))


# --- malicious report --------------------------------------------------------------

def action_for(risk: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.ACTION_BY_RISK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, risk), F.lit("CLEAN"))


def malicious_rows(df: DataFrame, anomaly="anomaly", key="id", carry=()) -> DataFrame:
    """Entities with at least one signal: risk, confidence, worst severity, action,
    and the ``carry`` columns."""
    a = F.col(anomaly)
    worst = F.array_max(F.transform(a["signals"], lambda s: findings.severity_rank(s["severity"])))
    return df.filter(F.size(a["signals"]) > 0).select(
        key, *carry, a["risk_level"].alias("risk_level"), a["confidence"].alias("confidence"),
        findings.rank_severity(worst).alias("highest_severity"),
        F.get(a["signals"], F.lit(0))["type"].alias("primary_signal"),
        F.size(a["signals"]).alias("signals"), action_for(a["risk_level"]).alias("action"))


def risk_summary(malicious: DataFrame) -> DataFrame:
    return malicious.groupBy("risk_level", "action").agg(F.count("*").alias("entities"))


def blocklist(malicious: DataFrame, label: Column) -> DataFrame:
    """One text line per HIGH or CRITICAL entity."""
    bad = malicious.filter(F.col("risk_level").isin("HIGH", "CRITICAL"))
    return bad.select(F.concat(label, F.lit(" # RISK: "), F.col("risk_level"), F.lit(" - "),
                               F.col("primary_signal")).alias("value"))


# --- injection report -----------------------------------------------------------------

def injection_rows(found: DataFrame, key="id", hits: str = None) -> DataFrame:
    """Per entity: hit count, worst severity, distinct rules."""
    n = F.lit(1) if hits is None else F.col(hits)
    return (found.filter(findings.is_injection(F.col("type"), F.col("rule")))
            .groupBy(key).agg(
                F.sum(n).alias("hits"),
                findings.rank_severity(F.max(findings.severity_rank(F.col("severity")))).alias("risk_level"),
                F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("patterns")))


def rule_hits(found: DataFrame, hits: str = None) -> DataFrame:
    n = F.lit(1) if hits is None else F.col(hits)
    return found.groupBy("rule").agg(F.sum(n).alias("hits"))


def top_risk(rows: DataFrame, n=10, key="id") -> DataFrame:
    return ranking.top(rows, ("-hits", key), n)


def detail_rows(found: DataFrame, key="id", shown=100) -> DataFrame:
    """Findings of injection rules; ``cell`` is the evidence as a table cell."""
    return found.filter(findings.is_injection(F.col("type"), F.col("rule"))).select(
        key, "rule", "severity", "evidence", T.table_cell(F.col("evidence"), shown).alias("cell"), "location", "confidence")
