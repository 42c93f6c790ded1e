"""URL, name, text and category scalars."""

from pyspark.sql import functions as F

from ..functions import bands, encoding, text as T, urls
from ..operators import categories, evidence, lexicon, match, resolve
from ..rules import classes, vocab
from ..session import expire, fresh_path
from ..sources import landed
from . import bindings as B
from .book import query

_STORAGE = r"regexp_replace(regexp_replace(trim(url), '/$', ''), '\.git$', '')"
_SEG = "string_split(regexp_replace(url, '^(https://)?(http://)?', ''), '/')"


@query("url_normal_forms", f"""
SELECT page_id, {_STORAGE} AS storage_url, {B.identity_sql('url')} AS identity_url, {_SEG}[1] AS host,
  CASE WHEN len({_SEG}) >= 3 THEN {_SEG}[2] ELSE '' END AS owner,
  string_split(regexp_replace(url, '/$', ''), '/')[-1] AS last_segment,
  sha256({_STORAGE}) AS storage_id, substr(sha256(url), 1, 16) AS short_id
FROM pages""")
def url_normal_forms(spark, d):
    u = F.col("url")
    return B.texts(spark, d, "pages").select(
        "page_id", urls.storage_url(u).alias("storage_url"), urls.identity_url(u).alias("identity_url"),
        urls.host(u).alias("host"), urls.owner(u).alias("owner"), urls.last_segment(u).alias("last_segment"),
        urls.storage_id(u).alias("storage_id"), urls.short_id(u).alias("short_id"))


@query("page_slugs", f"""
WITH {B.ENTS}, p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '/en/([^/]+)', 1) AS slug FROM pages)
SELECT 'page' AS kind, CAST(page_id AS VARCHAR) AS id, slug,
  {B.any_sql('slug', ('1', '7'))} AS relevant FROM p
UNION ALL
SELECT 'repo', id, regexp_extract(regexp_replace(regexp_replace(repo_url, '\\.git$', ''), '/$', ''),
  '^.*github\\.com/([^/]+/[^/]+)', 1), {B.any_sql('lower(name)', ('1', '7'))} FROM ents""")
def page_slugs(spark, d):
    marks = ("1", "7")
    pages = B.texts(spark, d, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("id"),
        urls.page_slug(F.col("url"), "/en/").alias("slug"))
    pages = pages.withColumn("relevant", landed.is_relevant_slug(F.col("slug"), marks, ()))
    repos = B.doc_entities(spark, d).select(
        F.lit("repo").alias("kind"), "id", urls.repo_path(F.col("repo_url")).alias("slug"),
        landed.is_relevant_slug(F.col("name"), marks, ()).alias("relevant"))
    return pages.unionByName(repos)


@query("names_and_slugs", """
WITH n AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS given,
  'https://github.com/' || source || '/' || lang || '_' || CAST(doc_id AS VARCHAR) || '.Kit/' AS url,
  CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END AS lic FROM documents),
m AS (SELECT *, coalesce(nullif(given, ''), string_split(regexp_replace(url, '/$', ''), '/')[-1]) AS name FROM n)
SELECT doc_id, md5(name) AS name_md5,
  trim(regexp_replace(translate(lower(name), ' _.', '---'), '[^a-z0-9-]', '', 'g'), '-') AS slug,
  CASE WHEN trim(lic) = '' THEN 'UNKNOWN' ELSE lic END AS license FROM m""")
def names_and_slugs(spark, d):
    n = F.col("doc_id")
    given = F.when(n % 3 == 0, "").otherwise(F.col("text"))
    url = F.concat(F.lit("https://github.com/"), "source", F.lit("/"), "lang", F.lit("_"),
                   n.cast("string"), F.lit(".Kit/"))
    named = B.texts(spark, d, "documents").select(
        "doc_id", urls.default_name(given, url).alias("name"),
        F.when(n % 4 == 0, " ").otherwise(F.col("source")).alias("lic"))
    return named.select("doc_id", F.md5("name").alias("name_md5"), urls.slug(F.col("name")).alias("slug"),
                        T.license_or_unknown(F.col("lic")).alias("license"))


_PHRASES = ("the ", "of and")


@query("text_cleanup", f"""
WITH t AS (SELECT doc_id, {B.FIRST_PARAGRAPH} AS first, replace(replace(text, 'the ', '[REDACTED]'), 'of and', '[REDACTED]') AS red,
  replace(replace(text, '|', '\\|'), chr(10), ' ') AS flat, text FROM documents)
SELECT doc_id, md5(CASE WHEN first <> '' THEN first ELSE trim(text, {B.BLANKS}) END) AS description,
  md5(red) AS redacted,
  CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS short,
  CASE WHEN length(flat) > 80 THEN substr(flat, 1, 80) || '...' ELSE flat END AS cell,
  md5(CASE WHEN contains(text, 'token') OR contains(text, 'Licen') THEN ''
       WHEN length(text) > 2048 THEN substr(text, 1, 2048) || '…' ELSE text END) AS cleaned,
  md5(CASE WHEN contains(text, 'token') OR contains(text, 'Licen') THEN '' ELSE text END) AS cleaned_whole
FROM t""")
def text_cleanup(spark, d):
    t = F.col("text")
    return B.texts(spark, d, "documents").select(
        "doc_id", F.md5(T.describe(t, t)).alias("description"), F.md5(T.redact(t, _PHRASES)).alias("redacted"),
        T.truncate(t, 150).alias("short"), T.table_cell(t, 80).alias("cell"),
        F.md5(T.clean_description(t, ("token", "Licen"), 2048)).alias("cleaned"),
        F.md5(T.clean_description(t, ("token", "Licen"))).alias("cleaned_whole"))


@query("html_stripped", """
SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain_md5,
  length(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain_chars FROM pages""")
def html_stripped(spark, d):
    plain = T.strip_tags(F.col("html"))
    return B.texts(spark, d, "pages").select(
        "page_id", F.md5(plain).alias("plain_md5"), F.length(plain).cast("long").alias("plain_chars"))


_README = r"""'Endpoint: ' || url || ' see (' || url || ') wss://' || 'x.example/mcp' || chr(10) || '<' || url || '>, stdio sse://h/' || CAST(page_id AS VARCHAR)"""


@query("url_extraction", f"""
WITH r AS (SELECT page_id, url, {_README} AS t FROM pages),
u AS (SELECT *, list_transform(list_filter(string_split_regex(t, '\\s+'), lambda w: regexp_matches(w, '^(https?|sse|wss)://')),
     lambda w: rtrim(w, ')"''<,')) AS words,
   list_transform(regexp_extract_all(t, 'https?://[^\\s<>"{{}}|\\\\^`\\[\\]]+'), lambda w: rtrim(w, '.,;:)]}}>')) AS found FROM r),
e AS (SELECT *, list_filter(words, lambda w: {B.any_sql('w', ('sse', 'mcp', 'blog'))}) AS eps FROM u)
SELECT page_id, array_to_string(words, ' ') AS token_urls, array_to_string(found, ' ') AS embedded_urls,
  array_to_string(eps, ' ') AS endpoints,
  array_to_string(list_transform(eps, lambda w: CASE WHEN starts_with(w, 'sse://') THEN 'sse' WHEN starts_with(w, 'wss://') THEN 'websocket'
     WHEN regexp_matches(w, '^https?://') THEN CASE WHEN contains(w, 'sse') THEN 'sse' ELSE 'http' END ELSE 'stdio' END), ' ') AS transports,
  CAST(len(list_filter(eps, lambda w: regexp_matches(w, '^(https|wss)://'))) AS INTEGER) AS tls_endpoints,
  'stdio,http' AS readme_transports, regexp_extract(t, '[Ee]ndpoint:[ \\t]*(http[^ \\n]*)', 1) AS labelled
FROM e""")
def url_extraction(spark, d):
    n = F.col("page_id").cast("string")
    readme = F.concat(F.lit("Endpoint: "), "url", F.lit(" see ("), "url", F.lit(") wss://x.example/mcp\n<"), "url",
                      F.lit(">, stdio sse://h/"), n)
    rows = B.texts(spark, d, "pages").select("page_id", readme.alias("t"))
    eps = urls.readme_endpoints(F.col("t"), ("sse", "mcp", "blog"))
    field = lambda name: F.array_join(F.transform("eps", lambda e: e[name]), " ")
    return rows.withColumn("eps", eps).select(
        "page_id", F.array_join(urls.token_urls(F.col("t")), " ").alias("token_urls"),
        F.array_join(urls.embedded_urls(F.col("t")), " ").alias("embedded_urls"),
        field("url").alias("endpoints"), field("transport").alias("transports"),
        F.size(F.filter("eps", lambda e: e["tls"])).alias("tls_endpoints"),
        F.array_join(urls.readme_transports(F.col("t")), ",").alias("readme_transports"),
        urls.labelled_endpoint(F.col("t")).alias("labelled"))


@query("transport_sets", f"""
WITH {B.ENTS}
SELECT id, array_to_string(list_concat(CASE WHEN list_contains(list_transform(endpoints, lambda e: e.transport), 'http') OR list_contains(list_transform(endpoints, lambda e: e.transport), '')
   THEN list_transform(list_sort(list_transform(list_distinct(list_transform(endpoints, lambda e: e.transport)),
     lambda t: struct_pack(p := list_position(list_transform(endpoints, lambda e: e.transport), t), t := t))), lambda s: s.t) ELSE [] END,
   CASE WHEN list_contains(list_transform(endpoints, lambda e: e.transport), language) THEN [] ELSE [language] END), '|') AS transports,
  lower(language) IN ('sse', 'streamable-http') AS streaming
FROM ents""")
def transport_sets(spark, d):
    return B.doc_entities(spark, d).select(
        "id", F.array_join(urls.endpoint_transports(F.col("endpoints"), F.col("language")), "|").alias("transports"),
        urls.is_streaming_transport(F.col("language")).alias("streaming"))


_KNOWN = {"src1.example.org": "official_gov_api", "example.org": "official_company", "src3": "third_party_api",
          "token": "community"}


def _known_sql():
    parts = []
    for dom, kind in _KNOWN.items():
        hit = f"coalesce(list_filter(us, lambda u: contains(lower(u), '{dom}'))[1], CASE WHEN contains(lower(raw_content), '{dom}') THEN '' END)"
        parts.append(f"SELECT id, '{dom}' AS name, '{kind}' AS type, {hit} AS url, "
                     f"{str(kind in ('official_gov_api', 'official_company')).lower()} AS official FROM k WHERE {hit} IS NOT NULL")
    return " UNION ALL ".join(parts)


@query("known_sources", f"""
WITH {B.ENTS}, k AS (SELECT id, raw_content, list_concat([repo_url, homepage], list_transform(endpoints, lambda e: e.url)) AS us FROM ents)
{_known_sql()}""")
def known_sources(spark, d):
    us = F.concat(F.array("repo_url", "homepage"), F.transform("endpoints", lambda e: e["url"]))
    return (B.doc_entities(spark, d)
            .select("id", F.explode(match.known_sources(us, F.col("raw_content"), _KNOWN)).alias("s"))
            .select("id", "s.*"))


@query("canonical_ids", f"""
WITH {B.ENTS}, c AS (SELECT id, CASE WHEN doc_id % 5 < 2 THEN repo_url ELSE '' END AS repo, CASE WHEN doc_id % 5 < 3 THEN name ELSE '' END AS nm,
  CASE WHEN doc_id % 5 = 4 THEN [] ELSE list_concat(list_transform(endpoints, lambda e: {B.identity_sql('e.url')}),
     list_transform(tools, lambda t: t.name)) END AS prints, repo_owner FROM ents)
SELECT id, sha256(CASE WHEN repo <> '' THEN {B.identity_sql('repo')} WHEN nm <> '' THEN nm
  WHEN len(prints) > 0 THEN array_to_string(list_concat([nm, repo_owner], list_sort(prints)), '|')
  ELSE nm || repo_owner END) AS cid FROM c""")
def canonical_ids(spark, d):
    k = F.col("doc_id") % 5
    none = F.array().cast("array<string>")
    return B.doc_entities(spark, d).select("id", urls.canonical_id(
        F.when(k < 3, F.col("name")).otherwise(""), F.when(k < 2, F.col("repo_url")).otherwise(""), F.col("repo_owner"),
        F.when(k == 4, none).otherwise(F.transform("endpoints", lambda e: e["url"])),
        F.when(k == 4, none).otherwise(F.transform("tools", lambda t: t["name"]))).alias("cid"))


@query("source_trust", f"""
WITH {B.ENTS}
SELECT trust_source, trust, count(*) AS entities, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS sources,
  count(*) AS primary_sources FROM ents GROUP BY ALL""")
def source_trust(spark, d):
    twice = F.when(F.col("doc_id") % 2 == 0, F.concat("sources", "sources")).otherwise(F.col("sources"))
    rows = B.doc_entities(spark, d).select(
        "trust_source", urls.source_trust(F.col("trust_source")).alias("trust"),
        resolve.mark_primary(twice).alias("marked"))
    return rows.groupBy("trust_source", "trust").agg(
        F.count("*").alias("entities"), F.sum(F.size("marked")).alias("sources"),
        F.sum(F.size(F.filter("marked", lambda s: s["primary"]))).alias("primary_sources"))


_RAW_CATEGORIES = ("Finance & Fintech", "taiwan_stock", "open data", "Real  Estate", "metro-tw", "unknown thing",
                   " SEARCH ", "devops", "traditional chinese", "tax_tw", "gis", "other", "open_data")


def _case(table, key, otherwise):
    whens = " ".join(f"WHEN {B.quote(a)} THEN {B.quote(b)}" for a, b in table.items())
    return f"CASE {key} {whens} ELSE {otherwise} END"


def _in(values):
    return "(" + ", ".join(B.quote(v) for v in values) + ")"


_A = _case(vocab.CATEGORY_ALIASES_A, "lower(trim(raw))", "lower(trim(raw))")
_B1 = _case(vocab.CATEGORY_ALIASES_B, "lower(trim(raw))", "lower(trim(raw))")


@query("category_folds", f"""
WITH c AS (SELECT p_partkey, {B.sql_pick(_RAW_CATEGORIES, 'p_partkey')} AS raw FROM part),
a AS (SELECT *, {_A} AS a0, trim(regexp_replace({_B1}, '[ _-]+', '-', 'g'), '-') AS b0 FROM c),
b AS (SELECT *, {_case(vocab.CATEGORY_ALIASES_B, 'b0', 'b0')} AS b1 FROM a)
SELECT p_partkey, raw, coalesce({_case(vocab.CATEGORY_PARENT, 'a0', 'NULL')}, CASE WHEN a0 IN {_in(vocab.VALID_CATEGORIES)} THEN a0 END, 'other') AS fold_a,
  coalesce({_case(vocab.CATEGORY_PARENT, 'b1', 'NULL')}, CASE WHEN b1 IN {_in(vocab.FUNCTIONAL_CATEGORIES)} THEN b1 END, 'other') AS fold_b
FROM b""")
def category_folds(spark, d):
    raw = B._pick(_RAW_CATEGORIES, F.col("p_partkey"))
    return B.table(spark, d, "part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", "raw", categories.fold_a(F.col("raw")).alias("fold_a"),
        categories.fold_b(F.col("raw")).alias("fold_b"))


# bytes in some encoding, what decides on them, and the text they stand for
_LANDED = (
    ("", "utf8", ""),
    ("E58FB0E781A3", "utf8", "台灣"),
    ("A578C657", "big5", "台灣"),
    ("C6A1C7FD", "gbk", "啤驱"),
    ("E974E920", "replaced", "\ufffdt\ufffd "),
)


@query("encoding_repair", f"""SELECT doc_id, {B.sql_pick(tuple(v for _, v, _ in _LANDED), 'doc_id')} AS verdict,
  md5(lang || '-' || {B.sql_pick(tuple(t for _, _, t in _LANDED), 'doc_id')}) AS text_md5 FROM documents""")
def encoding_repair(spark, d):
    """Landed bytes in four encodings, each with an answer known beforehand."""
    tail = F.unhex(B._pick(tuple(h for h, _, _ in _LANDED), F.col("doc_id")))
    landed_rows = B.texts(spark, d, "documents").select(
        "doc_id", F.concat(F.encode(F.concat("lang", F.lit("-")), "UTF-8"), tail).alias("raw"))
    return encoding.repair_frame(landed_rows, "raw").select("doc_id", "verdict", F.md5("text").alias("text_md5"))


@query("signal_file_hits", """WITH words AS (SELECT DISTINCT source AS word FROM documents UNION SELECT unnest(['-en', '-de']))
SELECT doc_id, word FROM documents JOIN words ON contains(source || '-' || lang, word)""")
def signal_file_hits(spark, d):
    """Dictionary files written from the table's sources; their missing list falls back to the default."""
    docs = B.table(spark, d, "documents")
    path = fresh_path(spark, "signals")
    docs.select(F.array("source").alias("sources")).distinct().write.json(path)
    expire(spark, path)
    words = landed.signals_table(spark, path, {"sources": ("none",), "languages": ("-en", "-de")})
    tagged = docs.select("doc_id", F.concat_ws("-", "source", "lang").alias("tag"))
    return lexicon.long_hits(tagged, "doc_id", "tag", words, "keyword").select("doc_id", F.col("keyword").alias("word"))


@query("base64_contents", """
SELECT doc_id, md5(CASE WHEN doc_id % 10 = 0 THEN '?' || text ELSE text END) AS text_md5 FROM documents""")
def base64_contents(spark, d):
    encoded = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("?"), "text")) \
               .otherwise(F.base64(F.encode("text", "UTF-8")))
    rows = B.texts(spark, d, "documents").select("doc_id", encoded.alias("content"))
    return landed.file_contents(rows).select("doc_id", F.md5("text").alias("text_md5"))


@query("timestamps_parsed", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y%m%dT%H%M%SZ') END AS run_id FROM events""")
def timestamps_parsed(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return B.table(spark, d, "events").select(
        "event_id", bands.run_id(bands.parse_rfc3339(text)).alias("run_id"))


@query("score_bands", f"""
SELECT o_orderkey, CAST(o_totalprice / 5000 AS DOUBLE) AS score,
  {B.band_sql('o_totalprice / 5000', vocab.REGION_BANDS, 'T0')} AS region_level,
  {B.band_sql('o_totalprice / 5000', vocab.AI_BANDS, 'A0')} AS ai_level,
  {B.band_sql('o_totalprice / 5000', vocab.GRADE_BANDS, 'F')} AS grade,
  CASE WHEN o_orderstatus = 'F' THEN 'ARCHIVED' WHEN o_orderdate > TIMESTAMP '2001-12-31' - INTERVAL 90 DAY THEN 'ACTIVE'
    WHEN o_orderdate > TIMESTAMP '2001-12-31' - INTERVAL 180 DAY THEN 'MAINTENANCE'
    WHEN o_orderdate > TIMESTAMP '2001-12-31' - INTERVAL 365 DAY THEN 'STALE' ELSE 'DORMANT' END AS activity
FROM orders""")
def score_bands(spark, d):
    score = F.col("o_totalprice") / 5000
    now = F.lit("2001-12-31 00:00:00").cast("timestamp")
    return B.table(spark, d, "orders").select(
        "o_orderkey", score.alias("score"), bands.region_level(score).alias("region_level"),
        bands.ai_level(score).alias("ai_level"), bands.grade(score).alias("grade"),
        bands.activity(F.col("o_orderdate"), now, F.col("o_orderstatus") == "F").alias("activity"))


def _weight_case(table, otherwise):
    return "CASE kind " + " ".join(f"WHEN {B.quote(k)} THEN {v}" for k, v in table.items()) + f" ELSE {otherwise} END"


_RULES = ("mcp_topic", "mcp_sdk_dependency", "runtime_handshake", "executable_entrypoint", "unknown_rule")
_RULE_W = "CASE rule " + " ".join(f"WHEN {B.quote(k)} THEN {v}" for k, v in classes.IDENTITY_WEIGHTS.items()) + " ELSE 0 END"


@query("evidence_confidence", f"""
WITH e AS (SELECT user_id, {B.sql_pick(tuple(classes.TYPE_WEIGHTS) + ('RULE_MATCH',), 'event_id')} AS kind,
  {B.sql_pick(_RULES, 'event_id')} AS rule, value / 500.0 AS conf FROM events)
SELECT user_id, bool_or(rule NOT IN {_in(classes.WEAK_RULES)}) AS strong, bool_or(rule NOT IN {_in(classes.BRIDGE_RULES)}) AS bridge,
  bool_or(rule IN {_in(classes.RUNTIME_RULES)}) AS runtime, round(least(avg(conf), 1.0), 6) AS mean_confidence,
  round(least(sum(conf * {_weight_case(classes.TYPE_WEIGHTS, 0.5)}) / sum({_weight_case(classes.TYPE_WEIGHTS, 0.5)}), 1.0), 6) AS type_confidence,
  round(least(sum(conf * {_RULE_W}), 100.0), 6) AS rule_confidence
FROM e GROUP BY user_id""")
def evidence_confidence(spark, d):
    rows = B.table(spark, d, "events").select(
        "user_id", B._pick(tuple(classes.TYPE_WEIGHTS) + ("RULE_MATCH",), F.col("event_id")).alias("type"),
        B._pick(_RULES, F.col("event_id")).alias("rule"), (F.col("value") / 500.0).alias("confidence"))
    out = evidence.long_flags(rows, "user_id")
    return out.select("user_id", "strong", "bridge", "runtime", *[
        F.round(c, 6).alias(c) for c in ("mean_confidence", "type_confidence", "rule_confidence")])


_LINES = f"""SELECT l_orderkey AS id, {B.sql_pick(tuple(classes.TYPE_WEIGHTS) + ('RULE_MATCH',), 'l_partkey')} AS kind,
  {B.sql_pick(_RULES, 'l_linenumber + l_partkey')} AS rule, l_quantity / 50.0 AS conf FROM lineitem"""


@query("evidence_arrays", f"""WITH e AS ({_LINES}) SELECT id, bool_or(rule NOT IN {_in(classes.WEAK_RULES)}) AS strong, bool_or(rule NOT IN {_in(classes.BRIDGE_RULES)}) AS bridge,
  bool_or(rule IN {_in(classes.RUNTIME_RULES)}) AS runtime, round(least(avg(conf), 1.0), 6) AS mean_confidence,
  round(least(sum(conf * {_weight_case(classes.TYPE_WEIGHTS, 0.5)}) / sum({_weight_case(classes.TYPE_WEIGHTS, 0.5)}), 1.0), 6) AS type_confidence,
  round(least(sum(conf * {_RULE_W}), 100.0), 6) AS rule_confidence, CAST(count(*) FILTER (kind = 'RUNTIME') AS INTEGER) AS runtime_items
FROM e GROUP BY id""")
def evidence_arrays(spark, d):
    """The array forms of the evidence filters and confidences, over the lines of an order."""
    n, k = F.col("l_partkey"), F.col("l_linenumber")
    item = F.struct(B._pick(tuple(classes.TYPE_WEIGHTS) + ("RULE_MATCH",), n).alias("type"), B._pick(_RULES, k + n).alias("rule"),
                    F.lit(0.0).alias("score"), (F.col("l_quantity") / 50.0).alias("confidence"))
    # an order has a handful of lines
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias("ev"))
    e = F.col("ev")
    return rows.select(
        "id", evidence.is_strong(e).alias("strong"), evidence.is_bridge(e).alias("bridge"), evidence.has_runtime(e).alias("runtime"),
        F.round(evidence.mean_confidence(e), 6).alias("mean_confidence"), F.round(evidence.type_weighted_confidence(e), 6).alias("type_confidence"),
        F.round(evidence.rule_weighted_confidence(e), 6).alias("rule_confidence"),
        F.size(evidence.by_type(e, "RUNTIME")).alias("runtime_items"))


_KINDS = tuple(classes.EVIDENCE_KINDS)
_KIND_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {B.quote(k)} AS type, {B.quote(src)} AS source, {'NULL' if rule is None else B.quote(rule)} AS fixed FROM documents"
    for k, (src, rule) in classes.EVIDENCE_KINDS.items())


@query("evidence_rows", f"""
WITH k AS ({_KIND_SQL}), e AS (SELECT d.doc_id, type, k.source, coalesce(fixed, 'lang_' || lang) AS rule,
  CASE WHEN type = 'README' THEN lang ELSE d.source END AS matched, CASE WHEN type = 'README' THEN text ELSE '' END AS snippet
  FROM k JOIN documents d ON d.doc_id = k.doc_id)
SELECT doc_id, type, source, rule, matched, substr(sha256(matched), 1, 16) AS content_hash, md5(snippet) AS snippet_md5, '2024-07-01 00:00:00' AS seen_at FROM e""")
def evidence_rows(spark, d):
    """Evidence of all five kinds; readme evidence carries the whole text."""
    docs = B.texts(spark, d, "documents")
    out = None
    for kind in _KINDS:
        readme = kind == "README"
        rows = evidence.typed_rows(
            docs, "doc_id", kind, F.col("lang" if readme else "source"), F.lit(0.7), B.as_of(),
            snippet=F.col("text") if readme else None, rule=F.concat(F.lit("lang_"), "lang"))
        out = rows if out is None else out.unionByName(rows)
    return out.select(
        "doc_id", "type", "source", "rule", "matched", "content_hash", F.md5("snippet").alias("snippet_md5"),
        F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))
