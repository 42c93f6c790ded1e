"""Statistics, health, quality, evaluation."""

from pyspark.sql import functions as F

from ..operators import endpoints, evaluate, quality as Q, stats as S
from ..rules import patterns, vocab
from . import bindings as B
from .book import query
from .q_views import ROWS, registry_rows

_BAND = "CASE WHEN health_points >= 8 THEN 'HEALTHY' WHEN health_points > 0 THEN 'DEGRADED' ELSE 'UNHEALTHY' END"


@query("statistics", f"""WITH {ROWS}
SELECT 'by_level' AS facet, region_level AS value, count(*) AS entities FROM registry GROUP BY 2
UNION ALL SELECT 'by_health', {_BAND}, count(*) FROM registry GROUP BY 2
UNION ALL SELECT 'quality_distribution', quality_grade, count(*) FROM registry GROUP BY 2
UNION ALL SELECT 'by_status', entity_status, count(*) FROM registry GROUP BY 2
UNION ALL SELECT 'by_classification', primary_class, count(*) FROM registry GROUP BY 2
UNION ALL SELECT 'total', 'entities', count(*) FROM registry
UNION ALL SELECT 'total', 'relevant', count(*) FILTER (region_level >= 'T1') FROM registry""")
def statistics(spark, d):
    return S.statistics(registry_rows(spark, d))


def _zero_sql():
    cols = {"by_level": "region_level", "by_health": "lower(CASE WHEN health = '' THEN 'unknown' ELSE health END)",
            "quality_distribution": "CASE WHEN quality_grade = '' THEN 'F' ELSE quality_grade END"}
    return " UNION ALL ".join(f"SELECT '{f}' AS facet, '{k}' AS value, count(*) FILTER ({cols[f]} = '{k}') AS entities FROM registry"
                              for f, ks in S.ZERO_FILLED.items() for k in ks)


@query("zero_filled_statistics", f"WITH {ROWS} {_zero_sql()}")
def zero_filled_statistics(spark, d):
    return S.zero_filled(registry_rows(spark, d), S.exported_facets())


@query("order_facets", """SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' ELSE 'priority' END AS facet,
  coalesce(o_orderstatus, o_orderpriority) AS value, count(*) AS entities FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""")
def order_facets(spark, d):
    return S.facet_counts(B.table(spark, d, "orders"),
                          {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})


@query("run_report", f"""WITH {ROWS}, o AS (SELECT *, repo_owner <> 'src9' AS ok FROM registry)
SELECT 'total' AS section, 'rows' AS value, count(*) AS rows FROM o
UNION ALL SELECT 'total', CASE WHEN ok THEN 'succeeded' ELSE 'failed' END, count(*) FROM o GROUP BY 2
UNION ALL SELECT 'classification', primary_class, count(*) FROM o WHERE ok GROUP BY 2
UNION ALL SELECT 'status', entity_status, count(*) FROM o WHERE ok GROUP BY 2
UNION ALL SELECT 'level', region_level, count(*) FROM o WHERE ok GROUP BY 2""")
def run_report(spark, d):
    return S.run_report(registry_rows(spark, d), F.col("repo_owner") != "src9", {
        "classification": F.col("primary_class"), "status": F.col("entity_status"), "level": F.col("region_level")})


@query("failed_ids", f"WITH {B.ENTS} SELECT id FROM ents WHERE repo_owner = 'src9'")
def failed_ids(spark, d):
    return S.failed_ids(B.doc_entities(spark, d), F.col("repo_owner") != "src9")


_KIND = {"view": "normalized", "click": "duplicate", "purchase": "verified", "signup": "relevant", "error": "failed"}


@query("run_counters", """SELECT strftime(ts, '%Y%m%d') AS crawl_id, count(*) AS candidates_found, count(*) FILTER (event_type = 'view') AS candidates_norm,
  count(*) FILTER (event_type = 'click') AS duplicates_removed, count(*) FILTER (event_type = 'signup') AS relevant_candidates,
  count(*) FILTER (event_type = 'purchase') AS verified, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""")
def run_counters(spark, d):
    kinds = F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv])
    log = B.table(spark, d, "events").select(F.date_format("ts", "yyyyMMdd").alias("crawl_id"),
                                             F.try_element_at(kinds, F.col("event_type")).alias("kind"))
    return S.run_counters(log, "crawl_id", "kind")


@query("latest_run", """WITH r AS (SELECT strftime(ts, '%Y%m%d') AS crawl_id, min(ts) AS started_at FROM events GROUP BY 1)
SELECT strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_started, count(*) AS runs FROM r""")
def latest_run(spark, d):
    runs = B.table(spark, d, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("crawl_id")).agg(F.min("ts").alias("started_at"))
    return S.latest_run(runs).select(F.date_format("last_started", "yyyy-MM-dd HH:mm:ss").alias("last_started"), "runs")


# --- health -----------------------------------------------------------------------------

_STATUS = {"view": 200, "click": 200, "purchase": 302, "signup": 404, "error": 503}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _STATUS.items()) + " END"
_HEALTH_SQL = f"""CASE WHEN event_id % 50 = 0 THEN 'UNKNOWN' WHEN event_id % 49 = 0 THEN 'UNAVAILABLE' WHEN {_STATUS_SQL} = 200 THEN 'HEALTHY'
  WHEN {_STATUS_SQL} >= 500 THEN 'UNAVAILABLE' ELSE 'DEGRADED' END"""


def _health(spark, d):
    codes = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])
    url = F.when(F.col("event_id") % 50 == 0, "").otherwise("https://x.example")
    return B.table(spark, d, "events").select("user_id", "event_id", endpoints.health(
        url, F.try_element_at(codes, F.col("event_type")), F.col("event_id") % 49 == 0).alias("health"))


@query("endpoint_health", f"SELECT health, count(*) AS probes FROM (SELECT {_HEALTH_SQL} AS health FROM events) GROUP BY health")
def endpoint_health(spark, d):
    return _health(spark, d).groupBy("health").agg(F.count("*").alias("probes"))


@query("worst_health", f"""WITH h AS (SELECT user_id, event_id, {_HEALTH_SQL} AS health FROM events),
w AS (SELECT user_id, (['HEALTHY', 'DEGRADED', 'UNAVAILABLE', 'INVALID', 'UNKNOWN'])[max(CASE health WHEN 'HEALTHY' THEN 1 WHEN 'DEGRADED' THEN 2 WHEN 'UNAVAILABLE' THEN 3 ELSE 5 END)] AS health
FROM h GROUP BY user_id)
SELECT u.user_id, coalesce(health, 'HEALTHY') AS health FROM (SELECT c_custkey AS user_id FROM customer) u LEFT JOIN w USING (user_id)""")
def worst_health(spark, d):
    """Every customer as a server; many were never probed."""
    servers = B.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return endpoints.server_health(servers, _health(spark, d), "user_id")


@query("repository_status", f"""WITH {B.ENTS} SELECT id, CASE WHEN doc_id % 29 = 0 THEN 'DELETED' WHEN archived THEN 'ARCHIVED' WHEN doc_id % 19 = 0 THEN 'DELETED'
  WHEN doc_id % 5 = 0 THEN 'ACTIVE' WHEN n_chars % 500 < 90 THEN 'ACTIVE' WHEN n_chars % 500 < 180 THEN 'MAINTENANCE' WHEN n_chars % 500 < 365 THEN 'STALE' ELSE 'DORMANT' END AS status FROM ents""")
def repository_status(spark, d):
    n = F.col("doc_id")
    return B.doc_entities(spark, d).select("id", endpoints.repository_status(
        F.when(n % 29 == 0, "").otherwise(F.col("repo_url")), F.col("archived"),
        F.when(n % 19 == 0, 404).otherwise(200), F.when(n % 5 != 0, F.col("pushed_at")), B.as_of()).alias("status"))


# --- quality ----------------------------------------------------------------------------

_DESC = "strlen(description)"
_STARS = "(stars >= 10)::INT + (stars >= 50)::INT + (stars >= 100)::INT"
_MAINT = "CASE WHEN n_chars % 500 < 90 THEN 15 WHEN n_chars % 500 < 180 THEN 12 WHEN n_chars % 500 < 365 THEN 8 ELSE 3 END"
_DESCRIBED = "len(list_filter(tools, lambda t: t.name <> '' AND t.description <> '')) > 0"
_SCHEMA = "len(list_filter(tools, lambda t: coalesce(t.input_schema, '') <> '')) > 0"
_CRIT = " OR ".join(f"regexp_matches(raw_content, {B.quote(p)})" for p in patterns.QUALITY_CRITICAL)
_TRANS = """list_distinct(list_transform(endpoints, lambda e: CASE WHEN e.transport <> '' THEN e.transport
  WHEN regexp_matches(e.url, '^https?://') THEN CASE WHEN e.tls THEN 'sse' ELSE 'http' END ELSE 'stdio' END))"""
_COMP = {
    "data_source": f"CASE ds_type {' '.join(f'WHEN {B.quote(k)} THEN {v}' for k, v in Q.ENGINE['data_source'].items())} ELSE 0 END",
    "maintenance": _MAINT,
    "documentation": f"CASE WHEN {_DESC} > 200 THEN 5 WHEN {_DESC} > 50 THEN 3 ELSE 0 END + CASE WHEN len(tools) > 0 THEN 3 ELSE 0 END + CASE WHEN len(tools) >= 5 THEN 2 ELSE 0 END",
    "mcp_compliance": f"least(3 * len({_TRANS}) + 5 + CASE WHEN len({_TRANS}) >= 2 THEN 2 ELSE 0 END, 15)",
    "tool_schema": f"least(CASE WHEN len(tools) > 0 THEN 3 ELSE 0 END + CASE WHEN {_DESCRIBED} THEN 3 ELSE 0 END + CASE WHEN {_SCHEMA} THEN 2 ELSE 0 END + CASE WHEN len(tools) >= 5 THEN 2 ELSE 0 END, 10)",
    "health": "CASE WHEN len(list_filter(endpoints, lambda e: starts_with(e.url, 'https://'))) > 0 THEN 10 ELSE 5 END",
    "repository": "3 + (stars >= 10)::INT + (forks >= 5)::INT",
    "license": f"CASE WHEN license IN ('', 'UNKNOWN') THEN 0 WHEN license IN ({', '.join(map(B.quote, Q.ENGINE['permissive']))}) THEN 5 ELSE 3 END",
    "security": f"CASE WHEN {_CRIT} THEN 0 ELSE 5 END",
    "community": f"{_STARS} + (forks >= 5)::INT + 1",
}


def _quality_sql(comp, rows=f"WITH {B.ENTS}", source="ents"):
    total = " + ".join(comp)
    return f"""{rows}, q AS (SELECT id, {', '.join(f'CAST({v} AS INTEGER) AS {k}' for k, v in comp.items())} FROM {source})
SELECT *, CAST(least({total}, 100) AS INTEGER) AS score, {B.band_sql(f'least({total}, 100)', vocab.GRADE_BANDS, 'F')} AS grade FROM q"""


def _quality_rows(df):
    q = F.col("quality")
    return df.select("id", *[q["components"][k].alias(k) for k in Q.COMPONENTS],
                     q["score"].alias("score"), q["grade"].alias("grade"))


@query("quality_engine", _quality_sql(_COMP))
def quality_engine(spark, d):
    return _quality_rows(Q.add(B.doc_entities(spark, d), Q.engine_components(B.as_of())))


_SEV = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
_LEGACY = {
    **_COMP,
    "data_source": f"CASE ds_type {' '.join(f'WHEN {B.quote(k)} THEN {v}' for k, v in Q.LEGACY['data_source'].items())} ELSE 0 END",
    "documentation": f"CASE WHEN {_DESC} > 200 THEN 5 ELSE 0 END + CASE WHEN len(tools) > 0 THEN 3 ELSE 0 END + CASE WHEN len(tools) >= 5 THEN 2 ELSE 0 END",
    "mcp_compliance": "least(3 * len(list_filter(list_distinct(list_transform(endpoints, lambda e: e.transport)), lambda t: t <> '')) + 5, 15)",
    "tool_schema": f"CASE WHEN len(tools) > 0 THEN 3 ELSE 0 END + CASE WHEN {_DESCRIBED} THEN 3 ELSE 0 END + CASE WHEN {_SCHEMA} THEN 2 ELSE 0 END + CASE WHEN {_SCHEMA} AND len(tools) >= 5 THEN 1 ELSE 0 END",
    "health": "CASE upper(health) WHEN 'HEALTHY' THEN 10 WHEN 'DEGRADED' THEN 5 ELSE 0 END",
    "repository": "3 + (stars >= 10)::INT",
    "license": f"CASE WHEN license IN ('', 'UNKNOWN') THEN 0 WHEN license IN ({', '.join(map(B.quote, Q.LEGACY['permissive']))}) THEN 5 ELSE 3 END",
    "security": f"greatest(5 - CASE WHEN doc_id % 2 = 0 THEN 0 ELSE CASE {B.sql_pick(_SEV, 'doc_id')} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 5 END END, 0)",
    "community": f"{_STARS} + (open_issues > 0)::INT + 1",
}


@query("quality_legacy", _quality_sql(_LEGACY, f"WITH {ROWS}", "registry"))
def quality_legacy(spark, d):
    n = F.col("doc_id")
    rows = registry_rows(spark, d).withColumn("finding_severities", F.when(
        n % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(B._pick(_SEV, n))))
    return _quality_rows(Q.add(rows, Q.legacy_components(B.as_of())))


# --- evaluation -------------------------------------------------------------------------

_PRED = "contains(text, 'token') OR contains(text, 'Licen') OR n_chars > 2000"
_METRICS = """SELECT {by} count(*) AS total, count(p) AS matched, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp,
  count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (e AND NOT p) AS fn FROM j {group}"""
_RATIOS = """SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round(coalesce(fp / nullif(tp + fp, 0), 0.0), 6) AS fdr,
  round(coalesce(fp / nullif(fp + tn, 0), 0.0), 6) AS fpr,
  CASE WHEN matched = 0 THEN NULL WHEN coalesce(fp / nullif(tp + fp, 0), 0.0) < 0.02 THEN 'EXCELLENT' WHEN coalesce(fp / nullif(tp + fp, 0), 0.0) < 0.05 THEN 'PASS' ELSE 'FAIL' END AS status FROM m"""
# labels are read for the documents 40 ids further on, so that the last ones have no document
_JOINED = f"""j AS (SELECT l.doc_id, l.quality = 1 AS e, d.p, l.toxic FROM (SELECT * REPLACE (doc_id + 40 AS doc_id) FROM labels) l LEFT JOIN
  (SELECT doc_id, {_PRED} AS p FROM documents) d USING (doc_id))"""


def _pairs(spark, d):
    t = F.col("text")
    predictions = B.texts(spark, d, "documents").select(
        "doc_id", (F.contains(t, F.lit("token")) | F.contains(t, F.lit("Licen")) | (F.col("n_chars") > 2000)).alias("predicted"))
    labels = B.table(spark, d, "labels").withColumn("doc_id", F.col("doc_id") + 40).withColumn("expected", F.col("quality") == 1)
    return evaluate.joined(labels, predictions, "doc_id")


def _rounded(df, *keys):
    ratios = ("precision", "recall", "f1", "fdr", "fpr")
    return df.select(*keys, "total", "matched", "tp", "fp", "tn", "fn",
                     *[F.round(c, 6).alias(c) for c in ratios], "status")


@query("classifier_metrics", f"WITH {_JOINED}, m AS ({_METRICS.format(by='', group='')}) {_RATIOS}")
def classifier_metrics(spark, d):
    return _rounded(evaluate.metrics(_pairs(spark, d)))


@query("classifier_metrics_by_group", f"WITH {_JOINED}, m AS ({_METRICS.format(by='toxic,', group='GROUP BY toxic')}) {_RATIOS}")
def classifier_metrics_by_group(spark, d):
    return _rounded(evaluate.metrics(_pairs(spark, d), by=("toxic",)), "toxic")


@query("misclassified", f"WITH {_JOINED} SELECT doc_id, CASE WHEN e THEN 'FN' ELSE 'FP' END AS outcome FROM j WHERE p IS NOT NULL AND e <> p")
def misclassified(spark, d):
    return evaluate.misclassified(_pairs(spark, d), "doc_id").select("doc_id", "outcome")
