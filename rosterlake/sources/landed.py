"""Scans of landed source responses, registry files and label folders.

Readers are typed: no schema inference pass over the data, and unreadable rows
become NULLs instead of failing the job.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import bands, encoding, urls
from ..rules import signals, vocab

ITEM = """struct<id:bigint,name:string,full_name:string,html_url:string,description:string,language:string,
  pushed_at:string,created_at:string,updated_at:string,owner:struct<login:string>,license:struct<spdx_id:string>,
  stargazers_count:int,forks_count:int,fork:boolean,archived:boolean,default_branch:string,topics:array<string>>"""
SEARCH = f"total_count int, incomplete_results boolean, items array<{ITEM}>"
TOPICS = "names array<string>"
REGISTRY = """servers array<struct<name:string,description:string,repository_url:string,homepage:string,
  registry_url:string,transport:array<string>,license:string,readme:string,version:string,runtime:string>>"""
LEGACY_SERVER = """struct<id:string,name:string,slug:string,description:string,category:array<string>,
  taiwan_relevance:struct<level:string,score:double>,repository:struct<url:string,name:string>,
  quality:struct<score:double,grade:string>,status:string,health:string,transport:array<string>>"""
LEGACY_FILE = f"schema_version string, servers array<{LEGACY_SERVER}>"
LABEL = """id string, name string, description string, raw_content string, topics array<string>,
  package_files map<string,string>, tools array<string>, is_mcp_server boolean, category string"""


def read_json(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=True, mode="PERMISSIVE", **options).json(path)


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Same shapes when responses landed as a text column."""
    return df.select("*", F.from_json(column, schema if schema.startswith("struct") else f"struct<{_ddl(schema)}>")
                     .alias("_doc")).drop(column).select("*", "_doc.*").drop("_doc")


def _ddl(schema: str) -> str:
    """'a int, b string' -> 'a:int,b:string' at the top level."""
    out, depth, part = [], 0, ""
    for ch in schema + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            name, kind = part.strip().split(None, 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def search_candidates(responses: DataFrame, source="github") -> DataFrame:
    """One candidate per search item, nested owner and licence flattened."""
    return (responses.select(F.explode("items").alias("i")).select(
        F.lit(source).alias("source"), F.col("i.html_url").alias("source_url"), F.col("i.name").alias("name"),
        F.col("i.description").alias("description"), F.col("i.html_url").alias("repo_url"),
        F.col("i.owner.login").alias("author"), F.col("i.stargazers_count").alias("stars"),
        F.col("i.forks_count").alias("forks"), F.col("i.language").alias("language"),
        F.coalesce("i.license.spdx_id", F.lit("")).alias("license"),
        bands.parse_rfc3339(F.col("i.pushed_at")).alias("pushed_at"),
        F.col("i.id").alias("external_id"), F.col("i.full_name").alias("full_name")))


def repository_details(items: DataFrame) -> DataFrame:
    """Repository columns from one-object-per-row details (columns of ``ITEM``)."""
    path = urls.repo_path(F.col("html_url"))
    parts = F.split(path, "/")
    return items.select(
        F.col("html_url").alias("repo_url"), F.get(parts, F.lit(0)).alias("repo_owner"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("repo_name"), F.col("stargazers_count").alias("stars"),
        F.col("forks_count").alias("forks"), "language",
        F.coalesce("license.spdx_id", F.lit("")).alias("license"), "topics", "default_branch",
        F.coalesce("archived", F.lit(False)).alias("archived"),
        *[bands.parse_rfc3339(F.col(c)).alias(c) for c in ("created_at", "updated_at", "pushed_at")])


def override_topics(repos: DataFrame, topics: DataFrame, key="repo_url") -> DataFrame:
    """A non-empty topic list replaces the repository's own."""
    fresh = topics.groupBy(key).agg(F.max("names").alias("_names"))
    return (repos.join(fresh, key, "left")
            .withColumn("topics", F.when(F.size("_names") > 0, F.col("_names")).otherwise(F.col("topics")))
            .drop("_names"))


def file_contents(files: DataFrame, content="content", out="text") -> DataFrame:
    """base64 file bodies as repaired text."""
    raw = files.withColumn("_raw", encoding.decode_base64(F.col(content)))
    return raw.withColumn(out, encoding.repair_simple(F.col("_raw"))).drop("_raw")


def registry_candidates(lists: DataFrame, source="registry") -> DataFrame:
    """Registry list and detail rows; an absent transport means stdio."""
    return (lists.select(F.explode("servers").alias("s")).select(
        F.lit(source).alias("source"), F.col("s.registry_url").alias("source_url"), F.col("s.name").alias("name"),
        F.col("s.description").alias("description"), F.col("s.repository_url").alias("repo_url"),
        F.col("s.homepage").alias("homepage"),
        F.get(F.split(F.regexp_extract(F.coalesce("s.repository_url", F.lit("")), r"(?s)^.*github\.com/(.*)\z", 1),
                      "/"), F.lit(0)).alias("repo_owner"),
        F.coalesce("s.license", F.lit("")).alias("license"), F.col("s.readme").alias("raw_content"),
        F.coalesce("s.transport", F.array(F.lit("stdio"))).alias("transport")))


# --- sitemaps --------------------------------------------------------------------

def sitemap_locs(maps: DataFrame, xml: str, element: str, key: str = None) -> DataFrame:
    """``loc`` values of a sitemap (``element='url'``) or index (``'sitemap'``)."""
    plain = F.regexp_replace(F.col(xml), r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", "")
    locs = F.transform(F.xpath(plain, F.lit(f"//{element}/loc/text()")), lambda u: F.trim(u))
    keys = [key] if key else []
    return maps.select(*keys, F.posexplode(locs).alias("position", "loc")).filter(F.col("loc") != "")


def server_sitemaps(index: DataFrame, marker="servers") -> DataFrame:
    """Sitemaps whose address contains the marker; all of them when none does."""
    hits = index.agg(F.count_if(F.contains("loc", F.lit(marker)))).scalar()
    return index.filter(F.contains("loc", F.lit(marker)) | (hits == 0))


def is_relevant_slug(slug: Column, region=signals.SLUG_REGION_TOKENS, protocol=signals.SLUG_PROTOCOL_TOKENS) -> Column:
    from ..functions import regex
    return regex.contains_any(F.lower(slug), tuple(region) + tuple(protocol))


def sitemap_candidates(locs: DataFrame, marker="/servers/", region=signals.SLUG_REGION_TOKENS,
                       protocol=signals.SLUG_PROTOCOL_TOKENS, order=("position",),
                       source="mcpserversorg") -> DataFrame:
    """First page per relevant slug.  The slug filter runs before the
    aggregation, so irrelevant pages never reach the shuffle."""
    slugged = locs.withColumn("slug", urls.page_slug(F.col("loc"), marker)) \
                  .filter((F.col("slug") != "") & is_relevant_slug(F.col("slug"), region, protocol))
    return (slugged.groupBy("slug").agg(F.min_by("loc", F.struct(*order, "loc")).alias("source_url"))
            .select(F.lit(source).alias("source"), "source_url", F.col("slug").alias("name")))


# --- registry files, labels, legacy rows -------------------------------------------

def legacy_servers(files: DataFrame, limit: int = 0) -> DataFrame:
    """Rows of legacy registry files; ``limit=0`` keeps all."""
    rows = files.select(F.explode("servers").alias("s")).select("s.*")
    return rows.limit(limit) if limit > 0 else rows


def labelled_fixtures(spark: SparkSession, folder: str, pattern="*.json") -> DataFrame:
    """Label files under ``positive/`` and ``negative/``; the folder is the label."""
    df = spark.read.schema(LABEL).options(
        multiLine=True, recursiveFileLookup=True, pathGlobFilter=pattern).json(folder)
    return df.withColumn("label", F.regexp_extract(F.col("_metadata.file_path"), r"/(positive|negative)/[^/]*\z", 1)) \
             .withColumn("expected", F.col("label") == "positive")


LEGACY_JSON = {
    "repository": "struct<url:string,owner:string,name:string,license:string,topics:array<string>,stars:int,archived:boolean>",
    "endpoints": "array<struct<url:string,transport:string,tls:boolean,type:string>>",
    "tools": "array<struct<name:string,description:string,input_schema:string>>",
    "resources": "array<struct<uri:string,name:string,description:string>>",
    "prompts": "array<struct<name:string,description:string>>",
    "data_sources": "array<struct<name:string,type:string,url:string,official:boolean>>",
}


def legacy_status(status: Column) -> Column:
    up = F.upper(status)
    return F.when(up.isin("VERIFIED", "CANDIDATE", "QUARANTINED", "REJECTED"), up).otherwise("DISCOVERED")


def legacy_rows(table: DataFrame) -> DataFrame:
    """Wide legacy rows: JSON columns decoded leniently (bad JSON -> NULL), old
    scores dropped because they are recomputed."""
    present = {c: s for c, s in LEGACY_JSON.items() if c in table.columns}
    parsed = table.withColumns({c: F.from_json(c, s, {"mode": "PERMISSIVE"}) for c, s in present.items()})
    return (parsed
            .withColumn("entity_status", legacy_status(F.col("status")))
            .withColumn("repo_url", F.coalesce("repository.url", F.lit("")))
            .withColumn("license", F.coalesce(F.nullif("repository.license", F.lit("")), "license", F.lit("")))
            .withColumns({c: bands.parse_rfc3339(F.col(c)) for c in ("first_seen", "last_seen") if c in table.columns}))


def seed_entities(rows: DataFrame, as_of: Column, description_limit=None) -> DataFrame:
    """Legacy registry rows as entities: cleaned text, heuristic class, static
    identity for servers.  ``description_limit`` cuts descriptions; by default they stay whole."""
    from ..functions import text as T
    from ..operators import classify
    cls = classify.seed_class(F.coalesce("category", F.array().cast("array<string>")),
                              F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")))
    return (rows.withColumn("primary_class", cls).select(
        "id", "name", "slug", T.clean_description(F.col("description"), limit=description_limit).alias("description"),
        F.coalesce("repository.url", F.lit("")).alias("repo_url"), "primary_class",
        F.lit(0.8).alias("class_confidence"), F.col("taiwan_relevance.score").alias("region_score"),
        F.col("taiwan_relevance.level").alias("region_level"),
        F.floor("quality.score").cast("int").alias("quality_score"), F.col("quality.grade").alias("quality_grade"),
        F.lit("DISCOVERED").alias("entity_status"),
        F.when(F.col("primary_class") == "MCP_SERVER", "STATIC_VERIFIED").otherwise("NOT_MCP").alias("identity_status"),
        F.col("primary_class").isin(*vocab.MCP_CLASSES).alias("protocol_related"),
        as_of.alias("first_seen"), as_of.alias("last_seen")))


# --- dictionaries ---------------------------------------------------------------------

def dictionary_table(spark: SparkSession, sets: dict) -> DataFrame:
    """Signal sets as a table (signal_set, position, keyword)."""
    rows = [(name, i, w) for name, words in sets.items() for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "signal_set string, position int, keyword string")


def load_signals(overrides: dict, defaults: dict) -> dict:
    """Each empty or missing list falls back to its default."""
    overrides = overrides or {}
    return {name: tuple(overrides.get(name) or words) for name, words in defaults.items()}


def load_signals_file(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Small dictionary file, a JSON object of word lists, as a parameter of a plan: it is read on the driver.
    ``signals_table`` reads dictionaries of any size."""
    schema = ", ".join(f"{n} array<string>" for n in defaults)
    rows = spark.read.schema(schema).option("multiLine", True).json(path).limit(1).collect()
    return load_signals(rows[0].asDict() if rows else {}, defaults)


def signals_table(spark: SparkSession, path: str, defaults: dict, multiline=False) -> DataFrame:
    """Dictionary files as a table (signal_set, keyword): JSON objects of word lists, any number of them, whose lists
    add up.  A set without words falls back to its default."""
    schema = ", ".join(f"{n} array<string>" for n in defaults)
    rows = spark.read.schema(schema).option("multiLine", multiline).json(path)
    sets = F.array(*[F.struct(F.lit(n).alias("signal_set"), F.col(n).alias("words")) for n in defaults])
    found = (rows.select(F.explode(sets).alias("s")).select("s.signal_set", F.explode("s.words").alias("keyword"))
             .filter("keyword is not null").distinct())
    plain = dictionary_table(spark, defaults).select("signal_set", "keyword")
    return found.unionByName(plain.join(found.select("signal_set").distinct(), "signal_set", "left_anti"))


# --- table access -----------------------------------------------------------------------

def by_id(table: DataFrame, value, key="id") -> DataFrame:
    """Row with the id, or an empty frame."""
    return table.filter(F.col(key) == value)


def ids(table: DataFrame, key="id") -> DataFrame:
    return table.select(key)


def link_sources(entities: DataFrame, links: DataFrame, sources: DataFrame, key="id",
                 source_key="source_id") -> DataFrame:
    """Entities with their source rows through the link table."""
    return entities.join(links, key).join(sources, source_key)
