"""Finding extraction, verdicts, anomalies and their reports."""

from pyspark.sql import functions as F

from ..functions import chars
from ..operators import anomaly, endpoints, findings as X
from ..rules import patterns as P, vocab
from ..sinks import exports
from . import bindings as B
from .book import query

# rules that hit the driver's prose, next to the default tables
PROSE = (
    P.FindingRule("credential_extraction", "token_assignment", "CRITICAL", r'token = "[0-9a-f]{40}"', ("token",)),
    P.FindingRule("prompt_injection", "phone_number", "MEDIUM", r"\+1 \(\d{3}\) \d{3}-\d{4}", ("+1 (",)),
    P.FindingRule("obfuscation", "symbol_run", "HIGH", r"[%$&*#]{3}"),
    P.FindingRule("shell_injection", "mail_address", "MEDIUM", r"(?i)\b[a-z]+\.\d+@[a-z0-9.]+\b", ("@",)),
    P.FindingRule("obfuscation", "accent_word", "HIGH", r"\bé[a-z]+\b"),
)
RULES = P.SCAN_RULES + PROSE


def _matches_sql(rules, families, text="text", source="documents", key="doc_id"):
    parts = []
    for r in rules:
        f = families[r.family]
        parts.append(
            f"SELECT {key}, {B.quote(r.family)} AS type, {B.quote(r.rule)} AS rule, {B.quote(r.severity)} AS severity, "
            f"{f.confidence}::DOUBLE AS confidence, {f.context} AS ctx, {text} AS t, {B.quote(r.pattern)} AS pat "
            f"FROM {source} WHERE regexp_matches({text}, {B.quote(r.pattern)})")
    return " UNION ALL ".join(parts)


def _counts_sql(rules, families, **kw):
    parts = []
    text, source, key = kw.get("text", "text"), kw.get("source", "documents"), kw.get("key", "doc_id")
    for r in rules:
        f = families[r.family]
        parts.append(
            f"SELECT {key}, {B.quote(r.family)} AS type, {B.quote(r.rule)} AS rule, {B.quote(r.severity)} AS severity, "
            f"{f.confidence}::DOUBLE AS confidence, CAST(len(regexp_extract_all({text}, {B.quote(r.pattern)})) AS INTEGER) AS hits "
            f"FROM {source} WHERE regexp_matches({text}, {B.quote(r.pattern)})")
    return " UNION ALL ".join(parts)


_HITS = f"hits AS ({_counts_sql(RULES, P.SCAN_FAMILIES, text='raw_content', source='ents', key='id')})"
_VERDICT = """v AS (SELECT id, CASE WHEN bool_or(severity IN ('CRITICAL', 'HIGH')) THEN 'QUARANTINED'
    WHEN bool_or(severity = 'MEDIUM') THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS status, sum(hits) AS findings,
    sum(hits * confidence) / sum(hits) AS confidence FROM hits GROUP BY id)"""


@query("finding_counts", f"WITH {B.ENTS}, {_HITS} SELECT * FROM hits")
def finding_counts(spark, d):
    return X.counts(B.doc_entities(spark, d), "id", "raw_content", RULES)


@query("finding_verdicts", f"""WITH {B.ENTS}, {_HITS}, {_VERDICT}
SELECT e.id, coalesce(status, 'CLEAN') AS status, CAST(coalesce(findings, 0) AS INTEGER) AS findings, round(coalesce(confidence, 1.0), 6) AS confidence
FROM ents e LEFT JOIN v ON v.id = e.id""")
def finding_verdicts(spark, d):
    df = X.verdict(B.doc_entities(spark, d).select("id", "raw_content"), "raw_content", RULES)
    s = F.col("security")
    return df.select("id", s["status"].alias("status"), s["findings"].alias("findings"),
                     F.round(s["confidence"], 6).alias("confidence"))


@query("finding_verdicts_long", f"""WITH {B.ENTS}, {_HITS}, {_VERDICT}
SELECT e.id, CASE WHEN repo_owner = 'src13' THEN 'BLOCKED' ELSE coalesce(status, 'CLEAN') END AS status,
  CAST(coalesce(findings, 0) AS BIGINT) AS findings, round(coalesce(confidence, 1.0), 6) AS confidence
FROM ents e LEFT JOIN v ON v.id = e.id""")
def finding_verdicts_long(spark, d):
    """The same verdict from a stored findings table, with manual overrides."""
    ents = B.doc_entities(spark, d)
    found = X.counts(ents, "id", "raw_content", RULES)
    verdicts = X.verdict_for_all(ents, found, "id", "hits")
    manual = ents.filter(F.col("repo_owner") == "src13").select("id", F.lit("BLOCKED").alias("status"))
    return X.apply_overrides(verdicts, manual, "id").select(
        "id", "status", "findings", F.round("confidence", 6).alias("confidence"))


_CONTEXTS = """p AS (SELECT *, regexp_extract_all(t, pat) AS found, string_split_regex(t, pat) AS between FROM m),
e AS (SELECT * EXCLUDE (found, between, t, pat), t, found, between, unnest(range(0, len(found))) AS position FROM p),
o AS (SELECT *, CAST(list_sum(list_transform(between[1:position + 1], lambda s: length(s))) + coalesce(list_sum(list_transform(found[1:position], lambda s: length(s))), 0) AS BIGINT) AS ofs,
   found[position + 1] AS matched FROM e)"""


def _context_query(rules, families, text, source, key):
    return f"""WITH {B.ENTS}, m AS ({_matches_sql(rules, families, text, source, key)}), {_CONTEXTS}
SELECT {key}, type, rule, CAST(position AS INTEGER) AS position, matched,
  substr(t, greatest(ofs - ctx, 0) + 1, ofs - greatest(ofs - ctx, 0) + length(matched) + ctx) AS evidence FROM o"""


@query("finding_contexts", _context_query(RULES, P.SCAN_FAMILIES, "raw_content", "ents", "id"))
def finding_contexts(spark, d):
    return X.extract(B.doc_entities(spark, d), "id", "raw_content", RULES) \
            .select("id", "type", "rule", "position", "matched", "evidence")


@query("finding_contexts_legacy", _context_query(P.LEGACY_RULES, P.LEGACY_FAMILIES, "raw_content", "ents", "id"))
def finding_contexts_legacy(spark, d):
    return X.extract(B.doc_entities(spark, d), "id", "raw_content", P.LEGACY_RULES, P.LEGACY_FAMILIES) \
            .select("id", "type", "rule", "position", "matched", "evidence")


@query("conversation_findings", f"""WITH h AS ({_counts_sql(RULES, P.SCAN_FAMILIES, text="text", source="conversations", key="conv_id, turn")})
SELECT rule, count(*) AS turns, CAST(sum(hits) AS BIGINT) AS hits FROM h GROUP BY rule""")
def conversation_findings(spark, d):
    turns = B.texts(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    found = X.counts(turns, "key", "text", RULES)
    return found.groupBy("rule").agg(F.count("*").alias("turns"), F.sum("hits").alias("hits"))


_ASSEMBLED = """array_to_string(list_filter(list_concat(list_concat([raw_content, description, slug],
  list_transform(tools, lambda t: t.description)), [ds_url]), lambda s: s <> ''), chr(10) || chr(10))"""


@query("assembled_findings", f"""WITH {B.ENTS}, a AS (SELECT id, {_ASSEMBLED} AS whole FROM ents),
h AS ({_counts_sql(RULES, P.SCAN_FAMILIES, text='whole', source='a', key='id')})
SELECT rule, count(*) AS entities, CAST(sum(hits) AS BIGINT) AS hits FROM h GROUP BY rule""")
def assembled_findings(spark, d):
    ents = B.doc_entities(spark, d)
    found = X.counts(ents.withColumn("whole", X.assemble(ents)), "id", "whole", RULES)
    return found.groupBy("rule").agg(F.count("*").alias("entities"), F.sum("hits").alias("hits"))


@query("transport_findings", f"""WITH {B.ENTS}, u AS (SELECT id, unnest(list_transform(endpoints, lambda e: e.url)) AS url FROM ents)
SELECT id, 'insecure_transport' AS type, url AS location FROM u WHERE starts_with(url, 'http://')
UNION ALL SELECT id, 'localhost_exposure', url FROM u WHERE {B.any_sql('lower(url)', P.LOCAL_ADDRESS_MARKS)}""")
def transport_findings(spark, d):
    return endpoints.transport_findings(B.doc_entities(spark, d)).select("id", "type", "location")


# --- text statistics and anomalies ---------------------------------------------------------

_ENTROPY = """ent AS (SELECT doc_id, sum(n) AS total, round(-sum(n / tot * log2(n / tot)), 4) AS entropy FROM
  (SELECT doc_id, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS tot
   FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id, c) GROUP BY doc_id)"""


@query("text_statistics", f"""WITH {_ENTROPY}
SELECT d.doc_id, coalesce(entropy, 0.0) AS entropy, CAST(length(regexp_replace(text, '[\\t\\n\\r\\x20-\\x7e]+', '', 'g')) AS INTEGER) AS non_text,
  round(length(regexp_replace(text, '[\\t\\n\\r\\x20-\\x7e]+', '', 'g')) / strlen(text), 6) AS ratio,
  CAST(coalesce(list_sum(list_transform(regexp_extract_all(text || ' ' || repeat('QUJD', d.doc_id % 120) || '=', {B.quote(P.BASE64_RUN)}), lambda r: length(r))), 0) AS INTEGER) AS base64,
  CAST({' + '.join(f"regexp_matches(text, {B.quote(p)})::INT" for _, p in P.MARKDOWN_SHAPES)} AS INTEGER) AS markdown
FROM documents d LEFT JOIN ent ON ent.doc_id = d.doc_id""")
def text_statistics(spark, d):
    t = F.col("text")
    encoded = F.concat(t, F.lit(" "), F.repeat(F.lit("QUJD"), (F.col("doc_id") % 120).cast("int")), F.lit("="))
    return B.texts(spark, d, "documents").select(
        "doc_id", F.round(chars.entropy(t), 4).alias("entropy"), chars.non_text_chars(t).alias("non_text"),
        F.round(chars.non_text_ratio(t), 6).alias("ratio"),
        chars.base64_mass(encoded).alias("base64"),
        chars.markdown_score(t).alias("markdown"))


_LIMITS = {"entropy": 4.2, "size_bytes": 3000, "non_text_ratio": 0.08}
_MD = " + ".join(f"regexp_matches(raw_content, {B.quote(p)})::INT" for _, p in P.MARKDOWN_SHAPES)
_NT = "length(regexp_replace(raw_content, '[\\t\\n\\r\\x20-\\x7e]+', '', 'g')) / strlen(raw_content)"
_SIG_CODE = " UNION ALL ".join(
    f"SELECT id, {B.quote(r.family)} AS type, {B.quote(r.severity)} AS severity, {P.ANOMALY_FAMILIES[r.family].confidence}::DOUBLE AS confidence "
    f"FROM ents WHERE regexp_matches(raw_content, {B.quote(r.pattern)})" for r in P.ANOMALY_RULES)
_ODD = """list_filter([CASE WHEN created < 90 THEN 'account_age' END, CASE WHEN followers <= 0 THEN 'followers' END,
   CASE WHEN bio = '' THEN 'no_bio' END, CASE WHEN repos < 5 THEN 'repos' END], lambda x: x IS NOT NULL)"""
SIGNALS_SQL = f"""ent AS (SELECT id, round(-sum(n / tot * log2(n / tot)), 9) AS entropy FROM
  (SELECT id, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY id)::DOUBLE AS tot
   FROM (SELECT id, unnest(string_split(raw_content, '')) AS c FROM ents) GROUP BY id, c) GROUP BY id),
acc AS (SELECT id, {_ODD} AS odd FROM (SELECT id, n_chars % 500 AS created, doc_id % 3 AS followers,
   CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'x' END AS bio, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 12 END AS repos FROM ents)),
signals AS (
  SELECT e.id, 'readme_entropy' AS type, 'HIGH' AS severity, 0.85::DOUBLE AS confidence FROM ents e JOIN ent USING (id) WHERE entropy > {_LIMITS['entropy']} AND ({_MD}) < 2
  UNION ALL SELECT id, 'readme_size_anomaly', 'MEDIUM', 0.75 FROM ents WHERE strlen(raw_content) > {_LIMITS['size_bytes']} AND ({_MD}) < 2
  UNION ALL {_SIG_CODE}
  UNION ALL SELECT id, 'account_anomaly', CASE len(odd) WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END, 0.7 FROM acc WHERE len(odd) >= 2
  UNION ALL SELECT id, 'non_text_ratio', 'HIGH', 0.8 FROM ents WHERE {_NT} > {_LIMITS['non_text_ratio']}),
risk AS (SELECT id, CASE WHEN c > 0 OR h >= 2 THEN 'CRITICAL' WHEN h > 0 OR m >= 3 THEN 'HIGH' WHEN m > 0 OR l >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
   conf, n, worst FROM (SELECT id, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h,
   count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l, avg(confidence) AS conf, count(*) AS n,
   max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS worst FROM signals GROUP BY id))"""


def _anomalies(spark, d):
    n, k = F.col("doc_id"), F.col("pushed_at")
    account = anomaly.account_signal(
        k, n % 3, F.when(n % 4 == 0, "").otherwise("x"), F.when(n % 5 != 0, n % 12), B.as_of())
    return anomaly.detect(B.doc_entities(spark, d), "raw_content", account=account, limits=_LIMITS)


@query("anomaly_risk", f"""WITH {B.ENTS}, {SIGNALS_SQL}
SELECT e.id, coalesce(risk_level, 'LOW') AS risk_level, round(coalesce(conf, 1.0), 6) AS confidence, CAST(coalesce(n, 0) AS INTEGER) AS signals
FROM ents e LEFT JOIN risk r ON r.id = e.id""")
def anomaly_risk(spark, d):
    a = F.col("anomaly")
    return _anomalies(spark, d).select("id", a["risk_level"].alias("risk_level"),
                                       F.round(a["confidence"], 6).alias("confidence"), F.size(a["signals"]).alias("signals"))


@query("anomaly_risk_long", f"""WITH {B.ENTS}, {SIGNALS_SQL} SELECT id, risk_level, round(conf, 6) AS confidence, n AS signals FROM risk""")
def anomaly_risk_long(spark, d):
    signals = anomaly.long_signals(_anomalies(spark, d), "id")
    return anomaly.risk_per_key(signals, "id").select("id", "risk_level", F.round("confidence", 6).alias("confidence"), "signals")


@query("malicious_findings", f"""WITH {B.ENTS}, {SIGNALS_SQL} SELECT type AS rule, severity, count(*) AS findings FROM signals GROUP BY ALL""")
def malicious_findings(spark, d):
    found = anomaly.as_findings(anomaly.long_signals(_anomalies(spark, d), "id"), "id")
    return found.groupBy("rule", "severity").agg(F.count("*").alias("findings"))


_ACTION = "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.ACTION_BY_RISK.items()) + " END"


@query("malicious_report", f"""WITH {B.ENTS}, {SIGNALS_SQL}
SELECT id, risk_level, round(conf, 6) AS confidence, (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[worst] AS highest_severity,
  CAST(n AS INTEGER) AS signals, {_ACTION} AS action FROM risk""")
def malicious_report(spark, d):
    rows = exports.malicious_rows(_anomalies(spark, d))
    return rows.select("id", "risk_level", F.round("confidence", 6).alias("confidence"), "highest_severity", "signals", "action")


@query("malicious_summary", f"WITH {B.ENTS}, {SIGNALS_SQL} SELECT risk_level, {_ACTION} AS action, count(*) AS entities FROM risk GROUP BY ALL")
def malicious_summary(spark, d):
    return exports.risk_summary(exports.malicious_rows(_anomalies(spark, d)))


_ORDER = "CASE type WHEN 'readme_entropy' THEN 0 WHEN 'readme_size_anomaly' THEN 1 WHEN 'obfuscation_lua' THEN 2 WHEN 'obfuscation_js' THEN 3 WHEN 'non_text_ratio' THEN 5 ELSE 6 END"


@query("blocklist", f"""WITH {B.ENTS}, {SIGNALS_SQL}, f AS (SELECT id, arg_min(type, {_ORDER}) AS first FROM signals GROUP BY id)
SELECT repo_owner || '/' || repo_name || ' # RISK: ' || risk_level || ' - ' || first AS value
FROM ents JOIN risk USING (id) JOIN f USING (id) WHERE risk_level IN ('HIGH', 'CRITICAL')""")
def blocklist(spark, d):
    rows = exports.malicious_rows(_anomalies(spark, d), carry=("repo_owner", "repo_name"))
    return exports.blocklist(rows, F.concat_ws("/", "repo_owner", "repo_name"))


# --- injection report -----------------------------------------------------------------------

_INJ = f"""{_HITS}, inj AS (SELECT id, sum(hits) AS hits, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS worst,
  array_to_string(list_sort(list(DISTINCT rule)), ', ') AS patterns FROM hits WHERE regexp_matches(lower(type || ' ' || rule), 'injection|prompt') GROUP BY id)"""


@query("injection_report", f"""WITH {B.ENTS}, {_INJ} SELECT id, CAST(hits AS BIGINT) AS hits, (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[worst] AS risk_level, patterns FROM inj""")
def injection_report(spark, d):
    return exports.injection_rows(finding_counts(spark, d), hits="hits")


@query("injection_top", f"""WITH {B.ENTS}, {_INJ} SELECT id, CAST(hits AS BIGINT) AS hits FROM inj ORDER BY hits DESC, id LIMIT 10""")
def injection_top(spark, d):
    return exports.top_risk(injection_report(spark, d)).select("id", "hits")


@query("rule_hits", f"WITH {B.ENTS}, {_HITS} SELECT rule, CAST(sum(hits) AS BIGINT) AS hits FROM hits GROUP BY rule")
def rule_hits(spark, d):
    return exports.rule_hits(finding_counts(spark, d), "hits")


@query("injection_details", f"""WITH {B.ENTS}, m AS ({_matches_sql(RULES, P.SCAN_FAMILIES, 'raw_content', 'ents', 'id')}), {_CONTEXTS},
c AS (SELECT id, rule, substr(t, greatest(ofs - ctx, 0) + 1, ofs - greatest(ofs - ctx, 0) + length(matched) + ctx) AS whole,
  replace(replace(substr(t, greatest(ofs - ctx, 0) + 1, ofs - greatest(ofs - ctx, 0) + length(matched) + ctx), '|', '\\|'), chr(10), ' ') AS ev, type FROM o)
SELECT id, rule, md5(whole) AS evidence_md5, CASE WHEN length(ev) > 100 THEN substr(ev, 1, 100) || '...' ELSE ev END AS cell FROM c
WHERE regexp_matches(lower(type || ' ' || rule), 'injection|prompt')""")
def injection_details(spark, d):
    found = X.extract(B.doc_entities(spark, d), "id", "raw_content", RULES)
    return exports.detail_rows(found).select("id", "rule", F.md5("evidence").alias("evidence_md5"), "cell")


@query("entities_with_findings", f"""WITH {B.ENTS}, {_HITS} SELECT language, count(*) AS entities FROM ents
WHERE id IN (SELECT id FROM hits WHERE severity = 'CRITICAL') GROUP BY language""")
def entities_with_findings(spark, d):
    """Existence as a semi join against the findings table."""
    ents = B.doc_entities(spark, d)
    critical = finding_counts(spark, d).filter(F.col("severity") == "CRITICAL").select("id")
    return ents.join(critical, "id", "left_semi").groupBy("language").agg(F.count("*").alias("entities"))
