"""Relevance scorers.  One engine, several rule tables.

A scorer is an evidence column plus a band ladder; ``add`` puts its verdict on a
frame.  All evidence is built map-side, so scoring never shuffles.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands, sqltext as S
from ..functions.arrays import computed_once, explode_rows
from ..rules import signals
from . import match


def _evidence(found: str, kind: str, source: str, rule: str) -> str:
    item = (f"named_struct('type', {S.quote(kind)}, 'source', {S.quote(source)}, 'rule', {S.quote(rule)}, "
            "'matched', h.word, 'score', h.points, 'confidence', 1.0D)")
    return f"transform({found}, h -> {item})"


class Scorer(NamedTuple):
    evidence: Column
    level: Callable[[Column], Column]


def add(df: DataFrame, name: str, scorer: Scorer) -> DataFrame:
    """Adds ``name`` as struct<score, level, confidence, evidence>.

    Evidence is its own projection, so it is computed once although score,
    level and confidence all derive from it.
    """
    ev, total = f"_{name}_evidence", f"_{name}_score"
    return (df
            .withColumn(ev, scorer.evidence)
            .withColumn(total, F.aggregate(F.col(ev), F.lit(0.0), lambda acc, e: acc + e["score"]))
            .transform(computed_once, name, F.struct(
                F.col(total).alias("score"), scorer.level(F.col(total)).alias("level"),
                F.when(F.size(ev) > 0, 1.0).otherwise(0.0).alias("confidence"),
                F.col(ev).alias("evidence")))
            .drop(ev, total))


def _in_each(values: str, dictionary, how) -> str:
    """Hits in every element of an array."""
    return f"flatten(transform({values}, v -> {match.hits_sql('v', dictionary, how)}))"


def _either(values: str, a: str, b: str, dictionary) -> str:
    """Per element, the terms that occur in field ``a`` or field ``b``, each once."""
    items = ", ".join(
        f"IF(contains(lower(v.{a}), {S.quote(t.word.lower())}) OR contains(lower(v.{b}), {S.quote(t.word.lower())}), "
        f"{match._literal(t)}, NULL)" for t in dictionary)
    per_item = f"array_compact(array({items}))" if items else match.hits_sql("''", ())
    return f"flatten(transform({values}, v -> {per_item}))"


def _concat(*parts) -> Column:
    return F.expr("concat(" + ", ".join(parts) + ")")


_RUNTIME_URLS = "transform(filter(endpoints, e -> e.type = 'MCP_RUNTIME_ENDPOINT'), e -> e.url)"


def region(signal_sets=signals.REGION_SIGNALS, how="contains") -> Scorer:
    """Field-weighted region score: domain 40, data source 40/35/30, topic 20,
    language and company 15, description 5; every (field, keyword) hit adds."""
    s, t = signal_sets, match.terms
    field = lambda name, words: match.hits_sql(name, words, how)
    domains, company = t(s["official_domains"], 40), t(s["company_keywords"], 15)
    sources = lambda words, pts: _either("data_sources", "name", "url", t(words, pts))
    rows = (
        (field("repo_url", domains), "official_domain", "repository_metadata", "official_taiwan_domain"),
        (field("homepage", domains), "official_domain", "repository_metadata", "official_taiwan_domain"),
        (_in_each(_RUNTIME_URLS, domains, how), "official_domain", "runtime_endpoint", "official_taiwan_domain"),
        (sources(s["government_agencies"], 40), "government_api", "data_source", "taiwan_government_api"),
        (sources(s["financial_keywords"], 35), "financial_api", "data_source", "taiwan_financial_api"),
        (sources(s["dataset_keywords"], 30), "dataset", "data_source", "taiwan_dataset"),
        (_in_each("topics", t(s["taiwan_keywords"], 20), how), "keyword", "repository_topics", "taiwan_keyword"),
        (field("language", t(s["language_keywords"], 15)), "language", "repository_language", "taiwan_language"),
        (field("repo_name", company), "company", "repository_name", "taiwan_company"),
        (_in_each("topics", company, how), "company", "repository_topics", "taiwan_company"),
        (field("description", t(s["taiwan_keywords"], 5)), "keyword", "description", "taiwan_readme_mention"),
    )
    return Scorer(_concat(*[_evidence(*r) for r in rows]), bands.region_level)


def ai(signal_sets=signals.AI_SIGNALS, how="contains") -> Scorer:
    """Field-weighted AI score over topics, description, packages, data sources
    and tools."""
    s, t = signal_sets, match.terms
    topics = lambda name, pts, rule: (
        _in_each("topics", t(s[name], pts), how), "keyword", "repository_topics", rule)
    tools = lambda name, pts, rule: (
        _either("tools", "name", "description", t(s[name], pts)), "ai_tool", "tool_definition", rule)
    all_text = "concat_ws(' ', description, array_join(topics, ' '))"
    rows = (
        topics("core_ai_keywords", 10, "core_ai_keyword"),
        topics("agent_keywords", 15, "agent_keyword"),
        topics("rag_keywords", 15, "rag_keyword"),
        topics("llm_provider_keywords", 10, "llm_provider_keyword"),
        topics("mcp_keywords", 20, "mcp_keyword"),
        topics("framework_keywords", 25, "framework_keyword"),
        (match.hits_sql("description", t(s["core_ai_keywords"], 5), how),
         "keyword", "description", "ai_description_mention"),
        (match.hits_sql(all_text, t(s["package_patterns"], 10), how),
         "package_dependency", "repository_metadata", "ai_package_pattern"),
        (_either("data_sources", "name", "url", t(s["core_ai_keywords"], 20)),
         "ai_data_source", "data_source", "ai_data_source"),
        tools("core_ai_keywords", 15, "ai_tool"),
        tools("agent_keywords", 25, "agent_tool"),
    )
    return Scorer(_concat(*[_evidence(*r) for r in rows]), bands.ai_level)


def legacy_terms(groups=signals.LEGACY_KEYWORD_GROUPS, points=signals.LEGACY_GROUP_POINTS,
                 default=signals.LEGACY_DEFAULT_POINTS) -> list:
    """Ordered groups -> one term per distinct word, owned by its first group."""
    owned = {}
    for group, words in groups:
        for w in words:
            owned.setdefault(w.lower(), match.Term(w, float(points.get(group, default)), group))
    return list(owned.values())


def _scored(words: str, pts, kind, source, rule) -> str:
    """Evidence of fixed points per word of an array."""
    return f"transform({words}, w -> {S.evidence(kind, source, rule, 'w', 1.0, pts)})"


def region_legacy(groups=signals.LEGACY_KEYWORD_GROUPS, points=signals.LEGACY_GROUP_POINTS,
                  domains=signals.LEGACY_OFFICIAL_DOMAINS, source_group="data_source") -> Scorer:
    """Older scorer: distinct official domains 40, distinct data-source words in
    URLs 35, keywords over the joined short fields by group."""
    urls = ("concat(array(repo_url, homepage), transform(endpoints, e -> e.url), transform(data_sources, d -> d.url))")
    # a separator no keyword contains keeps hits from spanning two fields
    texts = ("array_join(concat(array(name, description, repo_name, repo_owner, language, license), topics, "
             "flatten(transform(data_sources, d -> array(d.name, d.url)))), char(0))")
    found = lambda words: f"array_distinct({match.url_domains_sql(urls, words)})"
    return Scorer(_concat(
        _scored(found(domains), signals.LEGACY_DOMAIN_POINTS, "official_domain", "repository", "official_domain_match"),
        _scored(found(dict(groups).get(source_group, ())), signals.LEGACY_SOURCE_POINTS,
                "taiwan_financial_api", "repository", "financial_api_detected"),
        _evidence(match.hits_sql(texts, legacy_terms(groups, points)),
                  "repository_keyword", "repository", "taiwan_keyword"),
    ), bands.region_level)


_WHOLE_TEXT = "concat_ws(' ', name, description, repo_url, raw_content)"


def region_inline(words=signals.INLINE_REGION_KEYWORDS, url_marks=signals.INLINE_REGION_URL_MARKS,
                  word_points=signals.INLINE_REGION_POINTS,
                  url_points=signals.INLINE_REGION_URL_POINTS) -> Scorer:
    """Whole-text keywords plus points for every URL that looks regional."""
    urls = ("concat(array(repo_url), transform(endpoints, e -> e.url), transform(sources, s -> s.url))")
    regional = f"filter({urls}, u -> u <> '' AND {S.any_of('lower(u)', url_marks)})"
    return Scorer(_concat(
        _evidence(match.hits_sql(_WHOLE_TEXT, match.terms(words, word_points)),
                  "taiwan_keyword", "metadata", "taiwan_keyword_match"),
        _scored(regional, url_points, "official_domain", "repository", "official_domain_match"),
    ), bands.region_level)


def ai_inline(words=signals.INLINE_AI_KEYWORDS, word_points=signals.INLINE_AI_POINTS,
              combo_word=signals.INLINE_AI_COMBO_WORD,
              combo_points=signals.INLINE_AI_COMBO_POINTS) -> Scorer:
    """Whole-text keywords, plus points when the text also names the region."""
    return Scorer(_concat(
        _evidence(match.hits_sql(_WHOLE_TEXT, match.terms(words, word_points)),
                  "ai_keyword", "metadata", "ai_keyword_match"),
        _evidence(match.hits_sql(_WHOLE_TEXT, match.terms([combo_word], combo_points)),
                  "taiwan_ai_combo", "metadata", "taiwan_ai_combo"),
    ), bands.ai_level)


def long_evidence(df: DataFrame, key: str, verdict: str, dimension: str) -> DataFrame:
    """Evidence of one scorer as a long table."""
    return explode_rows(df, key, F.col(verdict)["evidence"], "e", "position") \
        .select(key, F.lit(dimension).alias("dimension"), "position", "e.*")


def score_long(evidence: DataFrame, key: str) -> DataFrame:
    """Score per (key, dimension) from a long evidence table."""
    return evidence.groupBy(key, "dimension").agg(
        F.sum("score").alias("score"), F.count("*").alias("hits"))
