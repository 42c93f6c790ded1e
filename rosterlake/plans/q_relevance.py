"""Dictionary matching and relevance scorers."""

from pyspark.sql import functions as F

from ..operators import lexicon, match, relevance as R
from ..rules import signals, vocab
from . import bindings as B
from .book import query

# dictionaries that occur in the driver's invented prose
WORDS = ("the", "und", "que", "tion", "token", "licen", "ción", "The ")
REGION = {
    "official_domains": ("src1.example.org", "example.org", "src12"),
    "government_agencies": ("src1", "SRC2"), "financial_keywords": ("src3",), "dataset_keywords": ("src4", "/de"),
    "payment_keywords": (), "taiwan_keywords": ("The", "der", "La ", "mcp"), "language_keywords": ("en", "FR"),
    "company_keywords": ("src7", "en-1"),
}
AI = {
    "core_ai_keywords": ("and", "une"), "agent_keywords": ("ing", "plan"), "rag_keywords": ("src1",),
    "llm_provider_keywords": ("src9",), "mcp_keywords": ("mcp", "es"), "framework_keywords": ("de",),
    "package_patterns": ("for", "que"),
}
GROUPS = (
    ("government", ("src1", "en")), ("finance", ("src2", "mit")), ("language", ("EN", "the ")),
    ("other_words", ("de", "apache")), ("data_source", ("data.src3", "example.com", "src2")),
)
DOMAINS = ("src1.example.org", "example.org")


def _hits_sql(words):
    return " UNION ALL ".join(
        f"SELECT doc_id, {B.quote(w)} AS word, {i}.0::DOUBLE AS points FROM documents WHERE contains(lower(text), {B.quote(w.lower())})"
        for i, w in enumerate(words))


@query("dictionary_hits", _hits_sql(WORDS))
def dictionary_hits(spark, d):
    terms = [match.Term(w, float(i)) for i, w in enumerate(WORDS)]
    return match.long_hits(B.texts(spark, d, "documents"), "doc_id", "text", terms).drop("label")


@query("dictionary_hits_large", f"""
SELECT word, count(*) AS documents FROM ({_hits_sql(tuple(f"a{c}" for c in "bcdefghilmnprstuvz"))}) GROUP BY word""")
def dictionary_hits_large(spark, d):
    """Same answer through the constant-array form that long dictionaries take."""
    words = [f"a{c}" for c in "bcdefghilmnprstuvz"] + [f"no such word {i}" for i in range(80)]
    hits = match.long_hits(B.texts(spark, d, "documents"), "doc_id", "text", match.terms(words))
    return hits.groupBy("word").agg(F.count("*").alias("documents"))


@query("dictionary_words", " UNION ALL ".join(
    f"SELECT doc_id, '{w}' AS word FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)')"
    for w in ("the", "und", "token")))
def dictionary_words(spark, d):
    return match.long_hits(B.texts(spark, d, "documents"), "doc_id", "text",
                           match.terms(("the", "und", "token")), match="word").select("doc_id", "word")


_BENCHMARK_WORDS = "words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM benchmark)"


def _benchmark_words(spark, d):
    """A dictionary that is a table: all words of the benchmark."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    return B.table(spark, d, "benchmark").select(F.explode(found).alias("word")).distinct()


@query("dictionary_table_hits", f"""WITH {_BENCHMARK_WORDS} SELECT word, count(*) AS documents FROM documents JOIN words ON contains(lower(text), word) GROUP BY word""")
def dictionary_table_hits(spark, d):
    """Documents that contain each word of a dictionary table, all words in one pass over a text."""
    hits = lexicon.long_hits(B.texts(spark, d, "documents"), "doc_id", "text", _benchmark_words(spark, d))
    return hits.groupBy("word").agg(F.count("*").alias("documents"))


@query("dictionary_table_words", f"""WITH {_BENCHMARK_WORDS}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents)
SELECT doc_id, count(*) AS words, md5(string_agg(word, ' ' ORDER BY word)) AS words_md5 FROM t SEMI JOIN words USING (word) GROUP BY doc_id""")
def dictionary_table_words(spark, d):
    """The same dictionary as whole words, per document."""
    hits = lexicon.long_hits(B.texts(spark, d, "documents"), "doc_id", "text", _benchmark_words(spark, d), match="word")
    return hits.groupBy("doc_id").agg(F.count("*").alias("words"), F.md5(F.array_join(F.sort_array(F.collect_set("word")), " ")).alias("words_md5"))


_HOST = r"^[a-z]+://([^/?#]+)"


@query("url_domain_table", f"""WITH h AS (SELECT DISTINCT regexp_extract(lower(url), '{_HOST}', 1) AS host FROM pages),
domains AS (SELECT host AS domain FROM h WHERE host <> '' UNION SELECT regexp_extract(host, '[^.]+[.][^.]+$', 0) FROM h WHERE host LIKE '%.%'),
hits AS (SELECT page_id, url, domain FROM pages JOIN domains ON contains(lower(url), domain))
SELECT page_id, url, first(domain ORDER BY length(domain) DESC, domain) AS first_domain, CAST(count(*) AS BIGINT) AS domains FROM hits GROUP BY page_id, url""")
def url_domain_table(spark, d):
    """Domains of a table found in URLs: the longest, and how many."""
    pages = B.table(spark, d, "pages")
    hosts = pages.select(F.regexp_extract(F.lower("url"), _HOST, 1).alias("host")).distinct().filter("host <> ''")
    domains = hosts.union(hosts.filter("host like '%.%'").select(F.regexp_extract("host", "[^.]+[.][^.]+$", 0))).distinct().toDF("domain")
    domains = domains.withColumn("at", F.struct((-F.length("domain")).alias("size"), "domain"))
    first = lexicon.url_domains(pages, "page_id", "array(url)", domains, "at").withColumnRenamed("domain", "first_domain")
    every = lexicon.url_domains(pages, "page_id", "array(url)", domains)
    return first.join(every.groupBy("page_id", "url").agg(F.count("*").alias("domains")), ["page_id", "url"])


@query("first_dictionary_hit", "SELECT doc_id, CASE " + " ".join(
    f"WHEN contains(lower(text), {B.quote(w.lower())}) THEN {B.quote(w)}" for w in WORDS[2:]) + " END AS word FROM documents")
def first_dictionary_hit(spark, d):
    return B.texts(spark, d, "documents").select(
        "doc_id", match.first_hit("text", match.terms(WORDS[2:]))["word"].alias("word"))


@query("url_domains", f"""
WITH {B.ENTS}, u AS (SELECT id, unnest([homepage, ds_url, repo_url]) AS url FROM ents)
SELECT id, array_to_string(list_sort(list(CASE WHEN contains(lower(url), '{DOMAINS[0]}') THEN '{DOMAINS[0]}'
   WHEN contains(lower(url), '{DOMAINS[1]}') THEN '{DOMAINS[1]}' END) FILTER (contains(lower(url), 'example.org'))), ',') AS first_domains,
  CAST(sum(contains(lower(url), '{DOMAINS[0]}')::INT + contains(lower(url), '{DOMAINS[1]}')::INT) AS INTEGER) AS all_domains
FROM u GROUP BY id""")
def url_domains(spark, d):
    us = "array(homepage, data_sources[0].url, repo_url)"
    return B.doc_entities(spark, d).select(
        "id", F.array_join(F.array_sort(match.url_domains(us, DOMAINS)), ",").alias("first_domains"),
        F.size(match.url_domains(us, DOMAINS, every=True)).alias("all_domains"))


_RUNTIME = "list_transform(list_filter(endpoints, lambda e: e.type = 'MCP_RUNTIME_ENDPOINT'), lambda e: e.url)"


def _ds(words, pts):
    return "(" + " + ".join(
        f"CASE WHEN contains(lower(ds_name), '{w.lower()}') OR contains(lower(ds_url), '{w.lower()}') THEN {pts} ELSE 0 END"
        for w in words) + ")"


REGION_SQL = " + ".join([
    B.points_sql("repo_url", REGION["official_domains"], 40), B.points_sql("homepage", REGION["official_domains"], 40),
    B.each_sql(_RUNTIME, REGION["official_domains"], 40), _ds(REGION["government_agencies"], 40),
    _ds(REGION["financial_keywords"], 35), _ds(REGION["dataset_keywords"], 30),
    B.each_sql("topics", REGION["taiwan_keywords"], 20), B.points_sql("language", REGION["language_keywords"], 15),
    B.points_sql("repo_name", REGION["company_keywords"], 15), B.each_sql("topics", REGION["company_keywords"], 15),
    B.points_sql("description", REGION["taiwan_keywords"], 5)])


def _tools(words, pts):
    inner = " + ".join(f"CASE WHEN contains(lower(t.name), '{w}') OR contains(lower(t.description), '{w}') THEN {pts} ELSE 0 END"
                       for w in words)
    return f"coalesce(list_sum(list_transform(tools, lambda t: {inner})), 0)"


AI_SQL = " + ".join([
    B.each_sql("topics", AI["core_ai_keywords"], 10), B.each_sql("topics", AI["agent_keywords"], 15),
    B.each_sql("topics", AI["rag_keywords"], 15), B.each_sql("topics", AI["llm_provider_keywords"], 10),
    B.each_sql("topics", AI["mcp_keywords"], 20), B.each_sql("topics", AI["framework_keywords"], 25),
    B.points_sql("description", AI["core_ai_keywords"], 5),
    B.points_sql("(description || ' ' || array_to_string(topics, ' '))", AI["package_patterns"], 10),
    _ds(AI["core_ai_keywords"], 20), _tools(AI["core_ai_keywords"], 15), _tools(AI["agent_keywords"], 25)])


def _scored(spark, d, scorer):
    df = R.add(B.doc_entities(spark, d), "r", scorer)
    return df.select("id", F.col("r.score").alias("score"), F.col("r.level").alias("level"),
                     F.col("r.confidence").alias("confidence"))


def _scored_sql(expr, band, low):
    return f"""WITH {B.ENTS}, s AS (SELECT id, CAST({expr} AS DOUBLE) AS score FROM ents)
SELECT id, score, {B.band_sql('score', band, low)} AS level, CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM s"""


@query("region_score", _scored_sql(REGION_SQL, vocab.REGION_BANDS, "T0"))
def region_score(spark, d):
    return _scored(spark, d, R.region(REGION))


@query("ai_score", _scored_sql(AI_SQL, vocab.AI_BANDS, "A0"))
def ai_score(spark, d):
    return _scored(spark, d, R.ai(AI))


_TEXTS = """list_concat(list_concat([name, description, repo_name, repo_owner, language, license], topics), [ds_name, ds_url])"""
_URLS = """list_concat(list_concat([repo_url, homepage], list_transform(endpoints, lambda e: e.url)), [ds_url])"""


def _distinct_first(words, pts):
    case = "CASE " + " ".join(f"WHEN contains(lower(u), {B.quote(w.lower())}) THEN {B.quote(w)}" for w in words) + " END"
    return f"{pts} * len(list_distinct(list_filter(list_transform({_URLS}, lambda u: {case}), lambda w: w IS NOT NULL)))"


def _legacy_sql():
    owned = {}
    for g, ws in GROUPS:
        for w in ws:
            owned.setdefault(w.lower(), signals.LEGACY_GROUP_POINTS.get(g, 5))
    parts = [f"CASE WHEN len(list_filter({_TEXTS}, lambda t: contains(lower(t), {B.quote(w)}))) > 0 THEN {p} ELSE 0 END"
             for w, p in owned.items()]
    return " + ".join([_distinct_first(DOMAINS, 40), _distinct_first(dict(GROUPS)["data_source"], 35)] + parts)


@query("region_score_legacy", _scored_sql(_legacy_sql(), vocab.REGION_BANDS, "T0"))
def region_score_legacy(spark, d):
    return _scored(spark, d, R.region_legacy(groups=GROUPS, domains=DOMAINS))


_WHOLE = "(name || ' ' || description || ' ' || repo_url || ' ' || raw_content)"
_INLINE_URLS = "list_concat(list_concat([repo_url], list_transform(endpoints, lambda e: e.url)), [homepage])"
_MARKS = ("src1", ".com/mcp")


@query("region_score_inline", _scored_sql(
    B.points_sql(_WHOLE, signals.INLINE_REGION_KEYWORDS, 15)
    + f" + 40 * len(list_filter({_INLINE_URLS}, lambda u: {B.any_sql('lower(u)', _MARKS)}))", vocab.REGION_BANDS, "T0"))
def region_score_inline(spark, d):
    return _scored(spark, d, R.region_inline(url_marks=_MARKS))


@query("ai_score_inline", _scored_sql(
    B.points_sql(_WHOLE, signals.INLINE_AI_KEYWORDS, 20) + " + " + B.points_sql(_WHOLE, ["token"], 10),
    vocab.AI_BANDS, "A0"))
def ai_score_inline(spark, d):
    return _scored(spark, d, R.ai_inline(combo_word="token"))


@query("evidence_scores", f"""
WITH {B.ENTS}, s AS (SELECT id, 'region' AS dimension, CAST({REGION_SQL} AS DOUBLE) AS score FROM ents
 UNION ALL SELECT id, 'ai', CAST({AI_SQL} AS DOUBLE) FROM ents)
SELECT id, dimension, score FROM s WHERE score > 0""")
def evidence_scores(spark, d):
    df = R.add(R.add(B.doc_entities(spark, d), "region", R.region(REGION)), "ai", R.ai(AI))
    long = R.long_evidence(df, "id", "region", "region").unionByName(R.long_evidence(df, "id", "ai", "ai"))
    return R.score_long(long, "id").drop("hits")


@query("entities_per_level", f"""
WITH {B.ENTS}, ranked AS (SELECT *, {B.CID_SQL} AS cid,
   row_number() OVER (PARTITION BY {B.CID_SQL} ORDER BY trust DESC, doc_id) AS rn,
   count(*) OVER (PARTITION BY {B.CID_SQL}) AS members FROM ents),
s AS (SELECT members, CAST({REGION_SQL} AS DOUBLE) AS score FROM ranked WHERE rn = 1)
SELECT {B.band_sql('score', vocab.REGION_BANDS, 'T0')} AS level, count(*) AS entities, CAST(sum(members) AS BIGINT) AS records,
  max(score) AS max_score FROM s GROUP BY 1""")
def entities_per_level(spark, d):
    """Flagship: canonical identity, best-trust merge, region score, facet."""
    from ..operators import resolve
    columns = ["repo_url", "homepage", "endpoints", "data_sources", "topics", "language", "repo_name", "description"]
    rows = resolve.with_canonical_id(B.doc_entities(spark, d)).select("cid", "trust", "doc_id", *columns)
    best = resolve.best_rows(rows, "cid", "trust", "doc_id", columns)
    scored = R.add(best, "region", R.region(REGION))
    return scored.groupBy(F.col("region.level").alias("level")).agg(
        F.count("*").alias("entities"), F.sum("members").alias("records"),
        F.max("region.score").alias("max_score"))
