"""Faceted filtering, text match and ranked search."""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import regex
from . import ranking

# fixed values of the ranking formula
LEVEL_SCORE = {"T5": 50.0, "T4": 40.0, "T3": 30.0, "T2": 20.0, "T1": 10.0, "T0": 0.0}
HEALTH_SCORE = {"HEALTHY": 15.0, "DEGRADED": 7.0}
REGION_WEIGHT, QUALITY_WEIGHT, CAPABILITY_WEIGHT = 0.3, 0.2, 15.0


@dataclass(frozen=True)
class EntityFilter:
    """Conjunctive filter; empty fields do not restrict."""
    entity_status: str = ""
    primary_class: str = ""
    identity_status: str = ""
    region_level: str = ""
    min_region_level: str = ""
    security_status: str = ""
    min_quality: int = 0

    def conditions(self) -> list:
        named = ("entity_status", "primary_class", "identity_status", "region_level", "security_status")
        out = [F.col(c) == getattr(self, c) for c in named if getattr(self, c)]
        if self.min_region_level:
            out += [F.col("region_level") >= self.min_region_level, F.col("region_level").between("T1", "T5")]
        if self.min_quality > 0:
            out.append(F.col("quality_score") >= self.min_quality)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        for condition in self.conditions():
            df = df.filter(condition)
        return df


def filter_counts(df: DataFrame, filters: dict) -> DataFrame:
    """(filter, entities) of several named filters, counted in one pass."""
    every = lambda conditions: reduce(lambda a, b: a & b, conditions, F.lit(True))
    wide = df.agg(*[F.count_if(every(f.conditions())).alias(f"_{i}") for i, f in enumerate(filters.values())])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"_{i}").alias("entities"))
                                          for i, n in enumerate(filters)])))


def listing(df: DataFrame, flt: EntityFilter = EntityFilter(), page=1, limit=ranking.DEFAULT_LIMIT,
            everything=False, text="") -> DataFrame:
    """Entity listing: level floor T1 unless ``everything``; filter first, then
    page, so totals and pages agree."""
    if not everything and not flt.min_region_level:
        df = df.filter(F.col("region_level").between("T1", "T5"))
    df = flt.apply(df)
    if text:
        df = df.filter(entity_text_match(text))
    return ranking.page(df, ("-quality_score", "id"), page, limit)


@dataclass(frozen=True)
class SearchQuery:
    text: str = ""
    level: str = ""
    categories: tuple = ()
    min_score: int = 0
    health: tuple = ()
    transports: tuple = ()
    official: bool = False
    limit: int = 0
    offset: int = 0
    order: tuple = field(default=("-score", "id"))


def _lowered(words) -> Column:
    return F.array(*[F.lit(w.lower()) for w in words])


def facets(q: SearchQuery) -> list:
    """Filter conditions of a query, cheap scalar ones first."""
    conds = []
    if q.level:
        conds.append(F.col("region_level") == q.level)
    if q.min_score > 0:
        conds.append(F.col("quality_score") >= q.min_score)
    if q.health:
        conds.append(F.upper("health").isin(*[h.upper() for h in q.health]))
    if q.categories:
        conds.append(F.arrays_overlap(F.transform("categories", F.lower), _lowered(q.categories)))
    if q.transports:
        conds.append(F.arrays_overlap(F.transform("transport", F.lower), _lowered(q.transports)))
    if q.official:
        conds.append(F.exists("sources", lambda s: regex.contains_any(
            F.lower(s["source"]), ("official", "registry"))))
    if q.text:
        conds.append(text_match(q.text))
    return conds


def _has(column: Column, needle: str) -> Column:
    return F.contains(F.lower(column), F.lit(needle))


def text_match(text: str) -> Column:
    """Name, description, categories, tools, resources or data sources."""
    q = text.lower()
    return (_has(F.col("name"), q) | _has(F.col("description"), q)
            | F.exists("categories", lambda c: _has(c, q))
            | F.exists("tools", lambda t: _has(t["name"], q) | _has(t["description"], q))
            | F.exists("resources", lambda r: _has(r["name"], q))
            | F.exists("data_sources", lambda d: _has(d["name"], q)))


def entity_text_match(text: str) -> Column:
    """Name, description, slug, repository URL or tool names."""
    q = text.lower()
    return (_has(F.col("name"), q) | _has(F.col("description"), q) | _has(F.col("slug"), q)
            | _has(F.col("repo_url"), q) | F.exists("tools", lambda t: _has(t["name"], q)))


def capability_match(text: str) -> Column:
    """Share of tools, resources and data sources that mention the text."""
    q = text.lower()
    join = lambda *parts: F.concat_ws(" ", *parts)
    texts = F.concat(
        F.transform("tools", lambda t: join(t["name"], t["description"])),
        F.transform("resources", lambda r: join(r["uri"], r["name"], r["description"])),
        F.transform("data_sources", lambda d: join(d["name"], d["url"])))
    return F.coalesce(F.try_divide(F.size(F.filter(texts, lambda s: _has(s, q))).cast("double"),
                                   F.size(texts)), F.lit(0.0))


def _points(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(0.0))


def relevance(q: SearchQuery) -> Column:
    score = (_points(LEVEL_SCORE, F.col("region_level")) + F.col("region_score") * REGION_WEIGHT
             + F.col("quality_score") * QUALITY_WEIGHT + _points(HEALTH_SCORE, F.upper("health")))
    return score + capability_match(q.text) * CAPABILITY_WEIGHT if q.text else score


def search(df: DataFrame, q: SearchQuery) -> DataFrame:
    for cond in facets(q):
        df = df.filter(cond)
    return ranking.top(df.withColumn("score", relevance(q)), q.order, q.limit, q.offset)


def search_by_capability(df: DataFrame, text: str, limit=0) -> DataFrame:
    """All matches, best first; ``limit`` keeps the best ones only."""
    return search(df, SearchQuery(text=text, limit=limit))
