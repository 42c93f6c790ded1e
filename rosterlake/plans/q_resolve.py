"""Entity resolution."""

from pyspark.sql import functions as F

from ..operators import resolve as S
from . import bindings as B
from .book import query

_RANK = f"""c AS (SELECT *, {B.CID_SQL} AS cid FROM ents),
r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY trust DESC, doc_id) AS rn FROM c)"""


def _identified(spark, d):
    return S.with_canonical_id(B.doc_entities(spark, d))


@query("resolved_entities", f"""WITH {B.ENTS}, {_RANK},
a AS (SELECT cid, count(*) AS members, max(last_seen) AS last_seen, arg_min(first_seen, rn) FILTER (license <> 'MIT') AS first_seen,
  arg_min(raw_content, rn) FILTER (license <> 'GPL-3.0') AS content FROM r GROUP BY cid)
SELECT a.cid, r.name, r.description, r.license, r.trust, members, md5(coalesce(content, '')) AS content_md5,
  strftime(a.first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(a.last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen
FROM a JOIN r ON r.cid = a.cid AND rn = 1""")
def resolved_entities(spark, d):
    rows = (_identified(spark, d)
            .withColumn("first_seen", F.when(F.col("license") != "MIT", F.col("first_seen")))
            .withColumn("raw_content", F.when(F.col("license") != "GPL-3.0", F.col("raw_content")).otherwise("")))
    merged = S.merge_scalars(rows, "cid", "trust", "doc_id", scalars=("name", "description", "license", "trust"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return merged.select("cid", "name", "description", "license", "trust", "members",
                         F.md5(F.coalesce("raw_content", F.lit(""))).alias("content_md5"),
                         stamp("first_seen"), stamp("last_seen"))


@query("best_rows_by_trust", f"""WITH {B.ENTS}, {_RANK} SELECT cid, doc_id, trust, trust_source FROM r WHERE rn = 1""")
def best_rows_by_trust(spark, d):
    return S.best_rows(_identified(spark, d), "cid", "trust", "doc_id",
                       ["doc_id", "trust", "trust_source"]).drop("members")


def _items_sql(column, key, extra=""):
    return f"""WITH {B.ENTS}, {_RANK}, i AS (SELECT cid, trust, doc_id, unnest({column}) AS item, generate_subscripts({column}, 1) AS pos FROM r),
k AS (SELECT *, {key} AS item_key, row_number() OVER (PARTITION BY cid, {key} ORDER BY trust DESC, doc_id, pos) AS n FROM i)
SELECT cid, item_key{extra}, doc_id AS from_doc, CAST(pos - 1 AS INTEGER) AS position FROM k WHERE n = 1"""


@query("merged_endpoints", _items_sql("endpoints", "item.url", ", item.transport AS transport"))
def merged_endpoints(spark, d):
    merged = S.merge_items(_identified(spark, d), "endpoints", "url", "cid", "trust", "doc_id")
    return merged.select("cid", "item_key", F.col("item.transport").alias("transport"),
                         F.col("rank_seq").alias("from_doc"), "position")


@query("merged_tools", _items_sql("tools", "item.name", ", item.description AS description"))
def merged_tools(spark, d):
    merged = S.merge_items(_identified(spark, d), "tools", "name", "cid", "trust", "doc_id")
    return merged.select("cid", "item_key", F.col("item.description").alias("description"),
                         F.col("rank_seq").alias("from_doc"), "position")


@query("merged_sources", f"""WITH {B.ENTS}, {_RANK}, k AS (SELECT cid, trust_source || '|' || homepage AS item_key, trust, doc_id FROM r)
SELECT cid, item_key, max(trust) AS trust, arg_max(doc_id, struct_pack(t := trust, s := -doc_id)) AS from_doc FROM k GROUP BY cid, item_key""")
def merged_sources(spark, d):
    key = lambda s: F.concat_ws("|", s["source"], s["url"])
    merged = S.merge_items(_identified(spark, d), "sources", key, "cid", "trust", "doc_id")
    return merged.select("cid", "item_key", F.col("item.trust_score").alias("trust"), F.col("rank_seq").alias("from_doc"))


_FILLED = """l AS (SELECT cid, trust, doc_id, unnest(range(1, doc_id % 3 + 2)) AS i, language, repo_owner FROM r),
i AS (SELECT cid, trust, doc_id, i, 'resources' AS list, 'file:///' || language || '/' || i AS item_key, repo_owner || ' ' || i AS detail FROM l
  UNION ALL SELECT cid, trust, doc_id, i, 'prompts', language || '_' || i, repo_owner || ' ' || i FROM l
  UNION ALL SELECT cid, trust, doc_id, i, 'data_sources', repo_owner || '-' || i, language FROM l)"""


@query("merged_lists", f"""WITH {B.ENTS}, {_RANK}, {_FILLED},
k AS (SELECT *, row_number() OVER (PARTITION BY cid, list, item_key ORDER BY trust DESC, doc_id, i) AS n FROM i),
o AS (SELECT cid, list, item_key || '=' || detail AS entry, trust, doc_id, i FROM k WHERE n = 1)
SELECT cid, list, string_agg(entry, ',' ORDER BY trust DESC, doc_id, i) AS entries FROM o GROUP BY cid, list""")
def merged_lists(spark, d):
    """Resources, prompts and data sources of an entity, merged over its records, item by item."""
    n = (F.col("doc_id") % 3 + 1).cast("int")
    each = lambda item: F.transform(F.sequence(F.lit(1), n), item)
    numbered = lambda c, i: F.concat_ws(" ", c, i.cast("string"))
    rows = _identified(spark, d).withColumns({
        "resources": each(lambda i: F.struct(F.concat_ws("/", F.lit("file://"), "language", i.cast("string")).alias("uri"),
                                             numbered("repo_owner", i).alias("name"))),
        "prompts": each(lambda i: F.struct(F.concat_ws("_", "language", i.cast("string")).alias("name"), numbered("repo_owner", i).alias("description"))),
        "data_sources": each(lambda i: F.struct(F.concat_ws("-", "repo_owner", i.cast("string")).alias("name"), F.col("language").alias("type")))})
    shown = {"resources": ("uri", "name"), "prompts": ("name", "description"), "data_sources": ("name", "type")}
    lists = {c: S.LIST_KEYS[c] for c in shown}
    merged = S.merge_lists(rows.select("cid", "trust", F.col("doc_id").alias("seq"), *lists), lists)
    entries = [F.struct(F.lit(c).alias("list"), F.array_join(F.transform(c, lambda x: F.concat_ws("=", x[a], x[b])), ",").alias("entries"))
               for c, (a, b) in shown.items()]
    return merged.select("cid", F.inline(F.array(*entries)))


@query("merged_topics", _items_sql("topics", "item", ", trust AS trust"))
def merged_topics(spark, d):
    merged = S.merge_words(_identified(spark, d), "topics", "cid", "trust", "doc_id")
    return merged.select("cid", "item_key", F.col("rank_trust").alias("trust"),
                         F.col("rank_seq").alias("from_doc"), "position")


@query("duplicate_report", f"""WITH {B.ENTS}, {_RANK} SELECT count(*) AS rows_in, count(DISTINCT cid) AS entities_out,
  count(*) - count(DISTINCT cid) AS duplicates_removed, (SELECT max(n) FROM (SELECT count(*) AS n FROM r GROUP BY cid)) AS largest_group FROM r""")
def duplicate_report(spark, d):
    return S.duplicate_report(_identified(spark, d))


@query("documents_resolved_by_text", """
SELECT md5(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS cid, count(*) AS members, min(doc_id) AS first_doc,
  arg_max(source, struct_pack(a := strlen(source), b := -doc_id)) AS best_source FROM documents GROUP BY 1""")
def documents_resolved_by_text(spark, d):
    """Exact copies after normalisation; trust is a property of the source."""
    text = F.regexp_replace(F.lower(F.trim("text")), r"[\t\n\f\r ]+", " ")
    rows = B.texts(spark, d, "documents").select(
        F.md5(text).alias("cid"), "doc_id", "source", F.octet_length("source").alias("trust"))
    best = S.best_rows(rows, "cid", "trust", "doc_id", ["source"], [F.min("doc_id").alias("first_doc")])
    return best.select("cid", "members", "first_doc", F.col("source").alias("best_source"))


@query("union_of_sources", """
SELECT kind, count(*) AS records, count(label) AS labelled, CAST(sum(size) AS BIGINT) AS chars FROM (
 SELECT 'documents' AS kind, lang AS label, length(text) AS size FROM documents
 UNION ALL SELECT 'pages', NULL, length(html) FROM pages
 UNION ALL SELECT 'benchmark', NULL, length(text) FROM benchmark) GROUP BY kind""")
def union_of_sources(spark, d):
    docs = B.texts(spark, d, "documents").select(F.lit("documents").alias("kind"), F.col("lang").alias("label"),
                                                 F.length("text").alias("size"))
    pages = B.texts(spark, d, "pages").select(F.lit("pages").alias("kind"), F.length("html").alias("size"))
    bench = B.table(spark, d, "benchmark").select(F.lit("benchmark").alias("kind"), F.length("text").alias("size"))
    return S.union_sources(docs, pages, bench).groupBy("kind").agg(
        F.count("*").alias("records"), F.count("label").alias("labelled"), F.sum("size").alias("chars"))


@query("first_per_slug", f"""WITH {B.ENTS} SELECT slug, min(doc_id) AS doc_id, arg_min(repo_url, doc_id) AS repo_url FROM ents GROUP BY slug""")
def first_per_slug(spark, d):
    return S.first_per_key(B.doc_entities(spark, d), "slug", [F.col("doc_id")], ["doc_id", "repo_url"])


@query("slug_collisions", f"""WITH {B.ENTS} SELECT slug, count(*) AS rows, min(id) AS first_id FROM ents GROUP BY slug HAVING count(*) > 1""")
def slug_collisions(spark, d):
    return S.collisions(B.doc_entities(spark, d))


@query("unique_slugs", f"""WITH {B.ENTS}, f AS (SELECT slug, min(id) AS first_id, count(*) AS n FROM ents GROUP BY slug)
SELECT id, CASE WHEN n > 1 AND id <> first_id THEN slug || '-' || substr(sha256(id), 1, 8) ELSE slug END AS slug FROM ents JOIN f USING (slug)""")
def unique_slugs(spark, d):
    return S.disambiguate(B.doc_entities(spark, d).select("id", "slug")).select("id", "slug")


@query("array_sets", f"""WITH {B.ENTS}, t AS (SELECT id, topics, list_transform(tools, lambda t: t.name) AS names FROM ents)
SELECT id, CAST(len(list_distinct(topics)) AS INTEGER) AS distinct_topics, CAST(len(list_distinct(list_concat(topics, names))) AS INTEGER) AS in_either,
  array_to_string(list_sort(list_distinct(list_filter(topics, lambda x: NOT list_contains(['plain', 'en', 'fr'], x)))), ',') AS remaining FROM t""")
def array_sets(spark, d):
    names = F.transform("tools", lambda t: t["name"])
    drop = F.array(F.lit("plain"), F.lit("en"), F.lit("fr"))
    return B.doc_entities(spark, d).select(
        "id", F.size(F.array_distinct("topics")).alias("distinct_topics"),
        F.size(F.array_union("topics", names)).alias("in_either"),
        F.array_join(F.array_sort(F.array_except("topics", drop)), ",").alias("remaining"))
