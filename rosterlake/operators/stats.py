"""Facet statistics, zero-filled distributions, run reports."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands
from ..rules import vocab

FACETS = ("by_level", "by_health", "quality_distribution", "by_status", "by_classification")


def health_band(points: Column) -> Column:
    return F.when(points >= 8, "HEALTHY").when(points > 0, "DEGRADED").otherwise("UNHEALTHY")


def facet_counts(df: DataFrame, facets: dict) -> DataFrame:
    """Long (facet, value, entities) for several facets at once.

    The facets are first counted together: vocabularies are small, so the joint
    count is a few thousand rows however large the input, and only that small
    cube is unpivoted.  Expanding the input once per facet would multiply it.
    """
    cube = df.groupBy(*[expr.alias(name) for name, expr in facets.items()]).agg(F.count("*").alias("_n"))
    entries = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value"))
                        for name in facets])
    return (cube.select(F.explode(entries).alias("e"), "_n").groupBy("e.facet", "e.value")
            .agg(F.sum("_n").alias("entities")))


def entity_facets() -> dict:
    return {
        "by_level": F.col("region_level"),
        "by_health": health_band(F.col("health_points")),
        "quality_distribution": F.col("quality_grade"),
        "by_status": F.col("entity_status"),
        "by_classification": F.coalesce(F.nullif(F.col("primary_class"), F.lit("")), F.lit("UNKNOWN")),
    }


def statistics(df: DataFrame) -> DataFrame:
    """All facets plus the totals, in one pass over the input."""
    counts = facet_counts(df, {**entity_facets(), "_relevant": bands.at_least_level(F.col("region_level"))})
    facets = counts.filter(F.col("facet") != "_relevant")
    totals = counts.filter(F.col("facet") == "_relevant").agg(
        F.sum("entities").alias("total"),
        F.sum(F.when(F.col("value") == "true", F.col("entities"))).alias("relevant"))
    rows = totals.select(F.inline(F.array(*[
        F.struct(F.lit("total").alias("facet"), F.lit(value).alias("value"),
                 F.coalesce(column, F.lit(0)).alias("entities"))
        for value, column in (("entities", "total"), ("relevant", "relevant"))])))
    return facets.unionByName(rows)


# fixed keys of the exported statistics file
ZERO_FILLED = {
    "by_level": ("T5", "T4", "T3", "T2", "T1", "T0"),
    "by_health": ("healthy", "degraded", "unavailable", "unknown"),
    "quality_distribution": vocab.GRADES,
}


def zero_filled(df: DataFrame, facets: dict, keys=None) -> DataFrame:
    """Counts for a fixed list of keys per facet; absent keys count 0."""
    keys = keys or ZERO_FILLED
    wide = df.agg(*[F.count_if(facets[f] == k).alias(f"{f}|{k}") for f, ks in keys.items() for k in ks])
    rows = F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(k).alias("value"),
                              F.col(f"`{f}|{k}`").alias("entities")) for f, ks in keys.items() for k in ks])
    return wide.select(F.inline(rows))


def exported_facets() -> dict:
    """Empty level counts as T0, empty grade as F, missing health as unknown."""
    blank = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return {"by_level": blank("region_level", "T0"),
            "by_health": F.lower(blank("health", "unknown")),
            "quality_distribution": blank("quality_grade", "F")}


def run_report(df: DataFrame, ok: Column, facets: dict) -> DataFrame:
    """Totals and distributions of a processing run; failed rows only count in
    the totals."""
    cube = df.groupBy(ok.alias("_ok"), *[e.alias(n) for n, e in facets.items()]).agg(F.count("*").alias("_n"))
    state = F.when(F.col("_ok"), "succeeded").otherwise("failed")
    entry = lambda section, value: F.struct(F.lit(section).alias("section"), value.cast("string").alias("value"))
    entries = F.concat(
        F.array(entry("total", F.lit("rows")), entry("total", state)),
        F.when(F.col("_ok"), F.array(*[entry(n, F.col(n)) for n in facets]))
        .otherwise(F.array().cast("array<struct<section:string,value:string>>")))
    return (cube.select(F.explode(entries).alias("e"), "_n").groupBy("e.section", "e.value")
            .agg(F.sum("_n").alias("rows")))


def failed_ids(df: DataFrame, ok: Column, key="id") -> DataFrame:
    """Failed ids as rows; they are written, never collected."""
    return df.filter(~ok).select(key)


def latest_run(runs: DataFrame, started="started_at") -> DataFrame:
    return runs.agg(F.max(started).alias("last_started"), F.count("*").alias("runs"))


def run_counters(events: DataFrame, key: str, kind: str) -> DataFrame:
    """Counters per run from a log of (run, kind) rows."""
    k = F.col(kind)
    return events.groupBy(key).agg(
        F.count("*").alias("candidates_found"),
        F.count_if(k == "normalized").alias("candidates_norm"),
        F.count_if(k == "duplicate").alias("duplicates_removed"),
        F.count_if(k == "relevant").alias("relevant_candidates"),
        F.count_if(k == "verified").alias("verified"),
        F.count_if(k == "failed").alias("failed"))
