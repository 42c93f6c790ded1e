"""Views, sections, reports and exports."""

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import categories, findings, views as V
from ..rules import vocab
from ..sinks import exports
from . import bindings as B
from .book import query

_CLASSES = vocab.PRIMARY_CLASSES
_IDS = vocab.IDENTITY_STATUSES
_SEC = vocab.SECURITY_STATUSES
_LEVELS = vocab.REGION_LEVELS
_CATS = ("Finance & Fintech", "metro", "open data", "devops", "gis", "nothing", "search")


def registry_rows(spark, d):
    """Entities with their verdict columns, spread over every vocabulary."""
    n, k = F.col("doc_id"), F.length("raw_content")
    return B.doc_entities(spark, d).withColumns({
        "primary_class": B._pick(_CLASSES, n), "identity_status": B._pick(_IDS, k),
        "security_status": B._pick(_SEC, n + k), "region_level": B._pick(_LEVELS, k + 1),
        "region_score": (k % 100).cast("double"), "quality_score": (k % 101).cast("int"),
        "quality_grade": B._pick(("A", "B", "", "D"), k), "health": B._pick(("healthy", "DEGRADED", "unavailable", ""), n),
        "entity_status": B._pick(vocab.ENTITY_STATUSES, n), "health_points": (n % 11).cast("int"),
        "categories": F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(
            F.array(B._pick(_CATS, n), B._pick(_CATS, k))),
        "transport": F.array_distinct(F.transform("endpoints", lambda e: e["transport"])),
        "prompts": F.array().cast("array<struct<name:string,description:string>>")})


ROWS = f"""{B.ENTS}, registry AS (SELECT *, {B.sql_pick(_CLASSES, 'doc_id')} AS primary_class, {B.sql_pick(_IDS, 'length(raw_content)')} AS identity_status,
  {B.sql_pick(_SEC, 'doc_id + length(raw_content)')} AS security_status, {B.sql_pick(_LEVELS, 'length(raw_content) + 1')} AS region_level,
  CAST(length(raw_content) % 100 AS DOUBLE) AS region_score, CAST(length(raw_content) % 101 AS INTEGER) AS quality_score,
  {B.sql_pick(('A', 'B', '', 'D'), 'length(raw_content)')} AS quality_grade, {B.sql_pick(('healthy', 'DEGRADED', 'unavailable', ''), 'doc_id')} AS health,
  {B.sql_pick(vocab.ENTITY_STATUSES, 'doc_id')} AS entity_status, CAST(doc_id % 11 AS INTEGER) AS health_points,
  CASE WHEN doc_id % 4 = 0 THEN [] ELSE [{B.sql_pick(_CATS, 'doc_id')}, {B.sql_pick(_CATS, 'length(raw_content)')}] END AS categories FROM ents)"""
_REL = "region_level >= 'T1'"
_isin = lambda *xs: "primary_class IN (" + ", ".join(B.quote(x) for x in xs) + ")"
_DATA = f"({_isin('AI_DATASET', 'AI_KNOWLEDGE_BASE', 'AI_API')} AND {_REL})"
VIEW_SQL = {
    "taiwan-ai-ecosystem": ("Other", _REL),
    "taiwan-mcp": ("MCP", f"{_isin('MCP_SERVER')} AND identity_status IN ('RUNTIME_VERIFIED', 'VERIFIED') AND {_REL} AND security_status <> 'BLOCKED'"),
    "taiwan-mcp-candidates": ("MCP", f"{_isin('MCP_SERVER')} AND identity_status IN ('CANDIDATE', 'STATIC_VERIFIED')"),
    "taiwan-ai-agents": ("AI", f"{_isin('AI_AGENT')} AND {_REL}"),
    "taiwan-ai-tools": ("AI", f"{_isin('AI_TOOL', 'AI_SDK', 'AI_FRAMEWORK', 'AI_PLUGIN')} AND {_REL}"),
    "taiwan-ai-data": ("Data", _DATA),
    "taiwan-ai-skills": ("AI", _isin("AI_SKILL", "MCP_SKILL")),
    "taiwan-ai-infrastructure": ("AI", _isin("AI_INFRASTRUCTURE")),
    "taiwan-ai-tutorials": ("Other", _isin("AI_TUTORIAL", "AI_EXAMPLE")),
    "taiwan-ai-collections": ("Other", _isin("AI_COLLECTION", "AI_REGISTRY", "MCP_COLLECTION")),
}
_SECTION = f"CASE WHEN {_isin(*vocab.MCP_CLASSES)} THEN 'mcp' WHEN {_isin(*vocab.AI_CLASSES)} THEN 'ai' WHEN {_DATA} THEN 'data' ELSE 'other' END"
_ONE_SECTION = {"taiwan-mcp": "verified", "taiwan-mcp-candidates": "candidates", "taiwan-ai-agents": "agents",
                "taiwan-ai-tools": "tools", "taiwan-ai-data": "data", "taiwan-ai-skills": "skills",
                "taiwan-ai-infrastructure": "infra", "taiwan-ai-tutorials": "tutorials", "taiwan-ai-collections": "collections"}
_GROUP = {g: i + 1 for i, g in enumerate(V.GROUP_ORDER)}
_COUNTS = " UNION ALL ".join(
    f"SELECT CAST({i + 1} AS INTEGER) AS position, '{s}' AS view, '{g}' AS view_group, count(*) FILTER ({p}) AS entities FROM registry"
    for i, (s, (g, p)) in enumerate(VIEW_SQL.items()))
_MEMBERS = " UNION ALL ".join(
    f"SELECT id, '{s}' AS view, {_SECTION if s == 'taiwan-ai-ecosystem' else B.quote(_ONE_SECTION[s])} AS section FROM registry WHERE {p}"
    for s, (_, p) in VIEW_SQL.items())


@query("view_counts", f"WITH {ROWS} {_COUNTS}")
def view_counts(spark, d):
    return V.counts(registry_rows(spark, d))


@query("view_index", f"""WITH {ROWS}, c AS ({_COUNTS}) SELECT *, CAST(CASE view_group {' '.join(f"WHEN '{g}' THEN {i}" for g, i in _GROUP.items())} END AS INTEGER) AS group_order FROM c""")
def view_index(spark, d):
    return V.index(registry_rows(spark, d))


@query("view_memberships", f"WITH {ROWS} {_MEMBERS}")
def view_memberships(spark, d):
    return V.memberships(registry_rows(spark, d))


@query("view_exports", f"WITH {ROWS}, m AS ({_MEMBERS}) SELECT view, section, id, count(*) OVER (PARTITION BY view) AS total_entities FROM m")
def view_exports(spark, d):
    return exports.view_rows(registry_rows(spark, d))


@query("strict_verified_view", f"""WITH {ROWS} SELECT id FROM registry WHERE {_isin('MCP_SERVER')} AND identity_status = 'RUNTIME_VERIFIED' AND {_REL} AND security_status <> 'BLOCKED'""")
def strict_verified_view(spark, d):
    view = V.catalogue(strict_verified=True)[1]
    return V.members(registry_rows(spark, d), view).select("id")


@query("view_report", f"""WITH {ROWS}, m AS (SELECT *, {_SECTION} AS section FROM registry WHERE {_REL})
SELECT section, id, name, repo_url AS url, quality_score, region_level, row_number() OVER (PARTITION BY section ORDER BY quality_score DESC, name, id) AS position FROM m""")
def view_report(spark, d):
    return exports.view_report(registry_rows(spark, d), V.catalogue()[0])


@query("section_totals", f"""WITH {ROWS}, m AS (SELECT {_SECTION} AS section FROM registry WHERE {_REL}),
s(section_order, section, title) AS (VALUES (1, 'mcp', 'MCP Servers & Tools'), (2, 'ai', 'AI Agents & Models'), (3, 'data', 'Data & Datasets'), (4, 'other', 'Other'))
SELECT s.section_order, s.section, s.title, count(m.section) AS entities FROM s LEFT JOIN m USING (section) GROUP BY ALL""")
def section_totals(spark, d):
    return V.section_totals(registry_rows(spark, d), V.catalogue()[0])


_FOLD = """CASE c WHEN 'Finance & Fintech' THEN 'finance' WHEN 'metro' THEN 'transport' WHEN 'open data' THEN 'government'
  WHEN 'gis' THEN 'geography' WHEN 'search' THEN 'search' ELSE 'other' END"""
_FOLDED = f"list_distinct(list_transform(categories, lambda c: {_FOLD}))"
_KEPT = f"""CASE WHEN len(list_filter({_FOLDED}, lambda c: c <> 'other')) > 0 THEN list_filter({_FOLDED}, lambda c: c <> 'other') ELSE {_FOLDED} END"""
_FIRST = "CASE " + " ".join(f"WHEN list_contains(kept, '{k}') THEN '{k}'" for k in vocab.FUNCTIONAL_CATEGORIES if k != "other") + " ELSE 'other' END"


@query("registry_report", f"""WITH {ROWS}, f AS (SELECT *, {_KEPT} AS kept FROM registry),
s AS (SELECT *, CASE WHEN region_level = 'T0' THEN 'international' ELSE {_FIRST} END AS section FROM f)
SELECT section, CAST(list_position({B.sql_list(vocab.FUNCTIONAL_CATEGORIES + ('international',))}, section) AS INTEGER) AS section_order, id,
 row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'international' THEN 0 ELSE -region_score END, name, id) AS position FROM s""")
def registry_report(spark, d):
    return exports.registry_report(registry_rows(spark, d)).select("section", "section_order", "id", "position")


@query("category_counts", f"""WITH {ROWS}, f AS (SELECT unnest(CASE WHEN len(categories) = 0 THEN ['uncategorized'] ELSE {_KEPT} END) AS category FROM registry)
SELECT category, count(*) AS entities FROM f GROUP BY category""")
def category_counts(spark, d):
    return categories.counts(registry_rows(spark, d))


@query("category_sections", f"""WITH {ROWS}, f AS (SELECT *, {_KEPT} AS kept FROM registry)
SELECT 'finance' AS section, count(*) FILTER (region_level <> 'T0' AND list_contains(kept, 'finance')) AS entities FROM f
UNION ALL SELECT 'other', count(*) FILTER (region_level <> 'T0' AND len(list_filter(kept, lambda c: c <> 'other')) = 0) FROM f
UNION ALL SELECT 'international', count(*) FILTER (region_level = 'T0') FROM f""")
def category_sections(spark, d):
    c, level = F.col("categories"), F.col("region_level")
    wide = registry_rows(spark, d).agg(
        F.count_if(categories.in_section(c, level, "finance")).alias("finance"),
        F.count_if(categories.in_section(c, level, "other")).alias("other"),
        F.count_if(level == "T0").alias("international"))
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.col(s).alias("entities")) for s in ("finance", "other", "international")])))


@query("source_counts", f"WITH {B.ENTS} SELECT trust_source AS source, count(*) AS entities FROM ents GROUP BY 1")
def source_counts(spark, d):
    return categories.source_counts(B.doc_entities(spark, d))


@query("source_counts_default", f"WITH {B.ENTS} SELECT 'github' AS source, count(*) AS entities FROM ents")
def source_counts_default(spark, d):
    bare = B.doc_entities(spark, d).withColumn("sources", F.filter("sources", lambda s: s["source"] == "nowhere"))
    return categories.source_counts(bare)


_CUT = "CASE WHEN length(description) > 150 THEN substr(description, 1, 150) || '...' ELSE description END"


@query("compat_list", f"""WITH {ROWS} SELECT id, name, description, {_CUT} AS summary, repo_url, license, quality_score, CAST(len(tools) AS INTEGER) AS tools
FROM registry WHERE {_isin('MCP_SERVER')} AND identity_status = 'RUNTIME_VERIFIED'""")
def compat_list(spark, d):
    return exports.compat_list(registry_rows(spark, d)).withColumn("tools", F.size("tools")).drop("tool_lines")


@query("server_views", f"""WITH {ROWS} SELECT id, CASE WHEN entity_status IN ('VERIFIED', 'CANDIDATE') THEN 'ACTIVE' WHEN entity_status = 'QUARANTINED' THEN 'DORMANT'
   WHEN entity_status = 'REJECTED' THEN 'ARCHIVED' ELSE 'UNKNOWN' END AS status, identity_status = 'RUNTIME_VERIFIED' AS verified,
  array_to_string(list_transform(list_filter(endpoints, lambda e: e.type = 'MCP_RUNTIME_ENDPOINT'), lambda e: e.transport), ',') AS transport
FROM registry WHERE {_isin('MCP_SERVER')} AND identity_status IN ('RUNTIME_VERIFIED', 'CANDIDATE', 'STATIC_VERIFIED')""")
def server_views(spark, d):
    rows = registry_rows(spark, d)
    shown = lambda df, flag: V.server_view(df).select("id", "status", F.lit(flag).alias("verified"),
                                                      F.array_join("transport", ",").alias("transport"))
    return shown(V.verified_servers(rows), True).unionByName(shown(V.server_candidates(rows), False))


@query("link_fallbacks", f"""WITH {B.ENTS} SELECT id, coalesce(CASE WHEN doc_id % 3 > 0 THEN repo_url END,
  list_filter(list_transform(endpoints, lambda e: CASE WHEN contains(e.url, 'wiki') THEN e.url END), lambda u: u IS NOT NULL)[1], '#') AS link FROM ents""")
def link_fallbacks(spark, d):
    typed = F.transform("endpoints", lambda e: F.struct(
        e["url"].alias("url"), F.when(F.contains(e["url"], F.lit("wiki")), "REPOSITORY_URL").otherwise("UNKNOWN").alias("type")))
    url = F.when(F.col("doc_id") % 3 > 0, F.col("repo_url")).otherwise("")
    return B.doc_entities(spark, d).select("id", urls.link_or_fallback(url, typed).alias("link"))


@query("registry_json", f"""WITH {ROWS} SELECT id, name, region_level AS level, region_score AS score, TRUE AS official, stars, quality_score AS quality, entity_status AS status,
  upper(CASE WHEN health = '' THEN 'unknown' ELSE health END) AS health, array_to_string(categories, '|') AS category FROM registry""")
def registry_json(spark, d):
    full = exports.registry_rows(registry_rows(spark, d), exports.health().alias("health"))
    return full.select(
        "id", "name", F.col("taiwan_relevance.level").alias("level"), F.col("taiwan_relevance.score").alias("score"),
        F.col("official_data_source").alias("official"), F.col("repository.stars").alias("stars"),
        F.col("quality.score").alias("quality"), "status", "health", F.array_join("category", "|").alias("category"))


@query("registry_parts", f"""WITH {ROWS} SELECT id, name, array_to_string(categories, '|') AS category, upper(CASE WHEN health = '' THEN 'unknown' ELSE health END) AS health FROM registry""")
def registry_parts(spark, d):
    """The minimal and the health file, joined back on the id."""
    rows = registry_rows(spark, d)
    small = exports.minimal_rows(rows).select("id", "name", F.array_join("category", "|").alias("category"))
    return small.join(exports.health_rows(rows).select("id", "health"), "id")


@query("safety_flags", f"""WITH {ROWS} SELECT id, security_status NOT IN ('BLOCKED', 'QUARANTINED') AS safe, security_status <> 'BLOCKED' AS listable,
  {_isin('MCP_SERVER')} AND identity_status = 'RUNTIME_VERIFIED' AS verified, {_isin(*vocab.MCP_CLASSES)} AS protocol_related, {_isin(*vocab.AI_CLASSES)} AS ai_related FROM registry""")
def safety_flags(spark, d):
    from ..operators import classify
    p, s = F.col("primary_class"), F.col("security_status")
    return registry_rows(spark, d).select(
        "id", findings.is_safe_for_registry(s).alias("safe"), findings.is_listable(s).alias("listable"),
        ((p == "MCP_SERVER") & (F.col("identity_status") == "RUNTIME_VERIFIED")).alias("verified"),
        classify.is_protocol_class(p).alias("protocol_related"), classify.is_ai_class(p).alias("ai_related"))


@query("view_flags", f"WITH {ROWS} SELECT id, {', '.join(f'({p}) AS ' + s.replace('-', '_') for s, (_, p) in VIEW_SQL.items())} FROM registry")
def view_flags(spark, d):
    flagged = V.flags(registry_rows(spark, d))
    return flagged.select("id", *[s.replace("-", "_") for s in VIEW_SQL])
