"""Landed responses, sitemaps, pages, manifests, probe logs."""

from pyspark.sql import functions as F

from ..operators import probes
from ..session import expire, fresh_path
from ..sources import landed, manifests, pages as P
from . import bindings as B
from .book import query


def _lower_host(column):
    return F.replace(F.col(column), F.lit("GitHub.com"), F.lit("github.com"))


def _items(spark, d):
    """Search items with the shape of a landed response, one response per row."""
    n = F.col("doc_id")
    return B.doc_entities(spark, d).select("doc_id", F.struct(
        n.alias("id"), F.col("name"), F.concat_ws("/", "repo_owner", "repo_name").alias("full_name"),
        _lower_host("repo_url").alias("html_url"), F.col("description"), F.col("language"),
        F.when(n % 6 == 0, "yesterday").otherwise(F.date_format("pushed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("pushed_at"),
        F.struct(F.col("repo_owner").alias("login")).alias("owner"),
        F.when(n % 5 > 0, F.struct(F.col("license").alias("spdx_id"))).alias("license"),
        F.col("stars").alias("stargazers_count"), F.col("forks").alias("forks_count"),
        F.col("archived"), F.array("language").alias("topics")).alias("item"))


@query("search_responses", f"""WITH {B.ENTS} SELECT name, replace(repo_url, 'GitHub.com', 'github.com') AS repo_url, repo_owner AS author, stars, CASE WHEN doc_id % 5 > 0 THEN license ELSE '' END AS license,
  CASE WHEN doc_id % 6 > 0 THEN strftime(pushed_at, '%Y-%m-%d %H:%M:%S') END AS pushed_at, doc_id AS external_id FROM ents""")
def search_responses(spark, d):
    bodies = _items(spark, d).select(F.to_json(F.struct(F.lit(1).alias("total_count"), F.array("item").alias("items"))).alias("body"))
    found = landed.search_candidates(landed.parse_json(bodies, "body", landed.SEARCH))
    return found.select("name", "repo_url", "author", "stars", "license",
                        F.date_format("pushed_at", "yyyy-MM-dd HH:mm:ss").alias("pushed_at"), "external_id")


@query("repository_details", f"""WITH {B.ENTS}, e AS (SELECT * REPLACE (replace(repo_url, 'GitHub.com', 'github.com') AS repo_url) FROM ents),
t AS (SELECT repo_url, max(doc_id) % 2 = 0 AS fresh FROM e GROUP BY 1)
SELECT e.repo_url, repo_owner, repo_name, min(CASE WHEN doc_id % 5 > 0 THEN license ELSE '' END) AS license, min(forks) AS forks,
  min(CASE WHEN fresh THEN repo_owner || ',new' ELSE language END) AS topics, bool_or(archived) AS archived
FROM e JOIN t ON t.repo_url = e.repo_url GROUP BY ALL""")
def repository_details(spark, d):
    """Detail bodies, then a landed topic list for every second repository."""
    bodies = _items(spark, d).select(F.to_json("item").alias("body"))
    repos = landed.repository_details(landed.parse_json(bodies, "body", landed.ITEM))
    latest = B.doc_entities(spark, d).groupBy(_lower_host("repo_url").alias("repo_url")).agg(F.max("doc_id").alias("n"), F.min("repo_owner").alias("o"))
    topics = latest.select("repo_url", F.when(F.col("n") % 2 == 0, F.array("o", F.lit("new")))
                           .otherwise(F.array().cast("array<string>")).alias("names"))
    return landed.override_topics(repos, topics).groupBy("repo_url", "repo_owner", "repo_name").agg(
        F.min("license").alias("license"), F.min("forks").alias("forks"),
        F.min(F.array_join("topics", ",")).alias("topics"), F.bool_or("archived").alias("archived"))


@query("registry_responses", f"""WITH {B.ENTS} SELECT name, repo_owner, CASE WHEN doc_id % 5 > 0 THEN license ELSE '' END AS license, md5(raw_content) AS readme_md5,
  CASE WHEN doc_id % 3 = 0 THEN 'stdio' ELSE 'sse,http' END AS transport FROM ents""")
def registry_responses(spark, d):
    n = F.col("doc_id")
    server = F.struct(
        F.col("name"), F.col("description"), _lower_host("repo_url").alias("repository_url"), F.col("homepage"),
        F.when(n % 5 > 0, F.col("license")).alias("license"), F.col("raw_content").alias("readme"),
        F.when(n % 3 > 0, F.array(F.lit("sse"), F.lit("http"))).alias("transport"))
    bodies = B.doc_entities(spark, d).select(F.to_json(F.struct(F.array(server).alias("servers"))).alias("body"))
    found = landed.registry_candidates(landed.parse_json(bodies, "body", landed.REGISTRY))
    return found.select("name", "repo_owner", "license", F.md5("raw_content").alias("readme_md5"),
                        F.array_join("transport", ",").alias("transport"))


@query("sitemap_candidates", f"""WITH p AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '/en/([^/]+)', 1) AS slug FROM pages)
SELECT slug AS name, arg_min(url, page_id) AS source_url FROM p WHERE slug <> '' AND {B.any_sql('slug', ('3', '8'))} GROUP BY slug""")
def sitemap_candidates(spark, d):
    loc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    maps = B.table(spark, d, "pages").select("page_id", F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), loc,
        F.lit(" </loc></url></urlset>")).alias("xml"))
    locs = landed.sitemap_locs(maps, "xml", "url", "page_id")
    return landed.sitemap_candidates(locs, "/en/", ("3",), ("8",), order=("page_id",)).select("name", "source_url")


@query("server_sitemaps", """SELECT 'https://' || source || '.example/servers/' || lang || '.xml' AS loc, count(*) AS maps FROM documents WHERE lang <> 'en' GROUP BY 1""")
def server_sitemaps(spark, d):
    index = B.table(spark, d, "documents").select("doc_id", F.concat(
        F.lit("<sitemapindex><sitemap><loc>https://"), "source", F.lit(".example/"),
        F.when(F.col("lang") != "en", "servers/").otherwise("blog/"), "lang",
        F.lit(".xml</loc></sitemap></sitemapindex>")).alias("xml"))
    locs = landed.sitemap_locs(index, "xml", "sitemap", "doc_id")
    return landed.server_sitemaps(locs).groupBy("loc").agg(F.count("*").alias("maps"))


_PARAGRAPH = """trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>.*?<p>(.*?)(?:</p>|<p>|</article>)', 1),
  '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'))"""


@query("page_extracts", f"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'https://github.com/o/r' || page_id ELSE '' END AS repo_url,
  CASE WHEN contains(url, '/en/') THEN '' ELSE url END AS homepage, CASE WHEN ends_with(url, '#top') THEN 'about ' || page_id ELSE '' END AS meta_description,
  {_PARAGRAPH} AS first_paragraph FROM pages)
SELECT *, array_to_string(list_filter([meta_description, first_paragraph], lambda x: x <> ''), chr(10) || chr(10)) AS readme FROM p""")
def page_extracts(spark, d):
    """Whole pages, with an absolute link and a description added from the URL."""
    n = F.col("page_id").cast("string")
    link = F.when(F.contains("url", F.lit("/en/")), F.concat(F.lit("https://github.com/o/r"), n, F.lit("/issues"))) \
            .otherwise(F.replace("url", F.lit("&"), F.lit("&amp;")))
    meta = F.when(F.endswith("url", F.lit("#top")), F.concat(F.lit('<meta name="description" content=" about '), n, F.lit('">'))).otherwise("")
    html = F.concat(meta, "html", F.lit('<a href="/local">l</a><a href="'), link, F.lit('">x</a>'))
    return P.extract(B.texts(spark, d, "pages").select("page_id", html.alias("html")))


_FILES = ("package.json", "server.json", "pyproject.toml", "go.mod", "Cargo.toml", "mcp.json")


def _files(spark, d):
    """A manifest per document in one of six formats, and a second file for some."""
    n, s, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    text = F.when(n % 6 == 0, F.concat(F.lit('{"name":"'), s, F.lit('","transport":"sse","command":"run-'), lang, F.lit('"}'))) \
        .when(n % 6 == 1, F.concat(F.lit('{"mcpServers":{"'), s, F.lit('":{"command":"npx","transport":"stdio","args":["-y","'), lang, F.lit('"]}}}'))) \
        .when(n % 6 == 2, F.concat(F.lit('[project]\nname = "x"\n[tool.mcp]\ncommand = "'), s, F.lit('"\ntransport = "'), lang, F.lit('"\n[other]\ncommand = "no"'))) \
        .when(n % 6 == 3, F.concat(F.lit("module example.com/"), s, F.lit("/"), lang, F.lit("\n\ngo 1.22\n"))) \
        .when(n % 6 == 4, F.concat(F.lit('[package]\nname = "'), s, F.lit('"\n[package.metadata.mcp]\ntransport = "'), lang, F.lit('"'))) \
        .otherwise(F.concat(F.lit('{"mcp":{"servers":{"'), s, F.lit('":{"command":"go","type":"http"}}},"name":"ignored"}')))
    first = B.table(spark, d, "documents").select(n.cast("string").alias("id"), B._pick(_FILES, n).alias("filename"), text.alias("content"))
    second = B.table(spark, d, "documents").filter(lang == "en").select(
        n.cast("string").alias("id"), F.lit("manifest.json").alias("filename"),
        F.when(n % 8 == 0, "{broken").otherwise('{"name":"late"}').alias("content"))
    return first.unionByName(second)


_MANIFEST_SQL = """SELECT CAST(doc_id AS VARCHAR) AS id, {files} AS filename,
  CASE doc_id % 6 WHEN 2 THEN '' WHEN 3 THEN 'example.com/' || source || '/' || lang ELSE source END AS server_name,
  CASE doc_id % 6 WHEN 0 THEN 'sse' WHEN 1 THEN 'stdio' WHEN 3 THEN 'stdio' WHEN 5 THEN 'http' ELSE lang END AS transport,
  CASE doc_id % 6 WHEN 0 THEN 'run-' || lang WHEN 1 THEN 'npx' WHEN 2 THEN source WHEN 5 THEN 'go' ELSE '' END AS command,
  CASE WHEN doc_id % 6 = 1 THEN '-y ' || lang ELSE '' END AS args FROM documents""".format(files=B.sql_pick(_FILES, "doc_id"))


def _manifest_columns(df):
    m = F.col("manifest")
    return df.select("id", "filename", m["server_name"].alias("server_name"), m["transport"].alias("transport"),
                     m["command"].alias("command"), F.array_join(m["args"], " ").alias("args"))


@query("manifests", f"""{_MANIFEST_SQL} UNION ALL SELECT CAST(doc_id AS VARCHAR), 'manifest.json', CASE WHEN doc_id % 8 > 0 THEN 'late' END,
  CASE WHEN doc_id % 8 > 0 THEN '' END, CASE WHEN doc_id % 8 > 0 THEN '' END, CASE WHEN doc_id % 8 > 0 THEN '' END FROM documents WHERE lang = 'en'""")
def manifests_query(spark, d):
    return _manifest_columns(manifests.parse(_files(spark, d)))


@query("deciding_manifests", _MANIFEST_SQL)
def deciding_manifests(spark, d):
    return _manifest_columns(manifests.first_manifest(manifests.parse(_files(spark, d))))


@query("file_types", """SELECT CASE WHEN ends_with(p_name, 't') THEN 'json' ELSE 'cargo.toml' END AS file_type, count(*) AS files FROM part GROUP BY 1""")
def file_types(spark, d):
    name = F.concat("p_name", F.when(F.endswith("p_name", F.lit("t")), ".txt").otherwise("/Cargo.toml"))
    return B.table(spark, d, "part").groupBy(manifests.file_type(name).alias("file_type")).agg(F.count("*").alias("files"))


@query("labelled_files", """SELECT CAST(l.doc_id AS VARCHAR) AS id, quality = 1 AS expected, length(text) AS chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def labelled_files(spark, d):
    """Label files written from the labelled documents and read again; the folder is the label."""
    docs = B.table(spark, d, "documents").join(B.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    one = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw_content"))
    # a file is one JSON array of a few labels
    files = docs.groupBy("quality", F.floor(F.col("doc_id") / 50).alias("file")).agg(F.to_json(F.collect_list(one)).alias("value"))
    folder = fresh_path(spark, "labels")
    for quality, name in ((1, "positive"), (0, "negative")):
        files.filter(F.col("quality") == quality).select("value").write.option("maxRecordsPerFile", 1).option("compression", "none").format(
            "text").save(f"{folder}/{name}")
    expire(spark, folder)
    rows = landed.labelled_fixtures(spark, folder, pattern="*.txt")
    return rows.select("id", "expected", F.length("raw_content").cast("long").alias("chars"))


# --- legacy rows and seeding -------------------------------------------------------------

@query("legacy_rows", f"""WITH {B.ENTS} SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'VERIFIED' WHEN doc_id % 4 = 1 THEN 'QUARANTINED' ELSE 'DISCOVERED' END AS entity_status,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE repo_url END AS repo_url, CASE WHEN doc_id % 7 = 0 OR license = '' THEN 'fallback' ELSE license END AS license,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(len(tools) AS INTEGER) END AS tools, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM ents""")
def legacy_rows(spark, d):
    n = F.col("doc_id")
    repo = F.to_json(F.struct(F.col("repo_url").alias("url"), "license"))
    old = B.doc_entities(spark, d).select(
        "id", F.when(n % 4 == 0, "verified").when(n % 4 == 1, "Quarantined").otherwise("whatever").alias("status"),
        F.when(n % 7 == 0, "{oops").otherwise(repo).alias("repository"), F.lit("fallback").alias("license"),
        F.when(n % 5 == 0, "not json").otherwise(F.to_json("tools")).alias("tools"),
        F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_seen"))
    return landed.legacy_rows(old).select(
        "id", "entity_status", "repo_url", "license", F.when(F.col("tools").isNotNull(), F.size("tools")).alias("tools"),
        F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


_CODES = ("AI_AGENT", "TOOL", "DATA", "TUTORIAL", "MYSTERY")
_CODE_CLASS = "CASE doc_id % 5 WHEN 0 THEN 'AI_AGENT' WHEN 1 THEN 'AI_TOOL' WHEN 2 THEN 'AI_DATASET' WHEN 3 THEN 'AI_TUTORIAL' ELSE 'MCP_SERVER' END"


@query("seeded_entities", f"""WITH {B.ENTS}, c AS (SELECT *, {_CODE_CLASS} AS primary_class FROM ents)
SELECT id, primary_class, CASE WHEN primary_class = 'MCP_SERVER' THEN 'STATIC_VERIFIED' ELSE 'NOT_MCP' END AS identity_status,
  CAST(floor(doc_id % 90 / 1.5) AS INTEGER) AS quality_score, md5(description) AS description_md5 FROM c""")
def seeded_entities(spark, d):
    n = F.col("doc_id")
    server = F.struct(
        F.col("id"), F.col("name"), F.col("slug"), F.col("description"), F.array(B._pick(_CODES, n)).alias("category"),
        F.struct(F.col("repo_url").alias("url")).alias("repository"),
        F.struct((n % 90 / 1.5).alias("score"), F.lit("C").alias("grade")).alias("quality"))
    files = B.doc_entities(spark, d).select(F.to_json(F.struct(F.lit("0.1").alias("schema_version"), F.array(server).alias("servers"))).alias("body"))
    rows = landed.legacy_servers(landed.parse_json(files, "body", landed.LEGACY_FILE))
    return landed.seed_entities(rows, B.as_of()).select(
        "id", "primary_class", "identity_status", "quality_score", F.md5("description").alias("description_md5"))


# --- probe logs ----------------------------------------------------------------------------

def _probe_log(spark, d):
    """Protocol responses per user: initialize and tools/list, some broken, some streamed."""
    u = F.col("user_id")
    users = B.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    init = F.to_json(F.struct(F.lit(1).alias("id"), F.struct(
        F.lit("2024-11-05").alias("protocolVersion"),
        F.create_map(F.lit("tools"), F.lit("{}"), F.lit("prompts"), F.lit("{}")).alias("capabilities")).alias("result")))
    tools = F.to_json(F.struct(F.lit(2).alias("id"), F.struct(F.transform(
        F.sequence(F.lit(1), (F.col("n") % 9 + 1).cast("int")),
        lambda i: F.struct(F.when(i == 9, "").otherwise(F.concat(F.lit("t"), i.cast("string"))).alias("name"))).alias("tools")).alias("result")))
    listed = lambda id_, name, n, item: F.to_json(F.struct(F.lit(id_).alias("id"), F.struct(
        F.transform(F.sequence(F.lit(1), (n + 1).cast("int")), item).alias(name)).alias("result")))
    streamed = F.concat(F.lit('event: message\ndata: {"id":99}\n\ndata: '), tools, F.lit("\n\n"))
    row = lambda method, status, body: F.struct(
        F.lit(method).alias("method"), status.cast("int").alias("http_status"), body.alias("body"),
        (F.col("n") % 100).cast("int").alias("latency_ms"))
    rows = F.array(
        row("initialize", F.when(u % 7 == 0, F.lit(None)).otherwise(200), init),
        row("tools/list", F.when(u % 5 == 0, 500).otherwise(200),
            F.when(u % 4 == 0, F.lit("{bad")).when(u % 3 == 0, streamed).otherwise(tools)),
        row("resources/list", F.lit(200), listed(3, "resources", F.col("n") % 13, lambda i: F.struct(
            F.when(i == 2, "").otherwise(F.concat(F.lit("file:///r"), i.cast("string"))).alias("uri"), F.lit("r").alias("name")))),
        row("prompts/list", F.when(u % 6 == 0, 404).otherwise(200), listed(4, "prompts", F.lit(3), lambda i: F.struct(
            F.concat(F.lit("p"), i.cast("string")).alias("name")))))
    return users.select(u.alias("id"), F.explode(rows).alias("r")).select("id", "r.*")


@query("probe_verdicts", """WITH u AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT *, n % 9 + 1 AS listed, CASE WHEN n % 9 + 1 = 9 THEN 8 ELSE n % 9 + 1 END AS named, id % 7 = 0 AS lost, id % 5 = 0 OR id % 4 = 0 AS bad FROM u)
SELECT id, CASE WHEN lost THEN 'ERROR' WHEN bad THEN 'FAILED' ELSE 'PASSED' END AS status, CAST(CASE WHEN bad THEN 0 ELSE named END AS INTEGER) AS tool_count,
  CASE WHEN bad THEN NULL ELSE array_to_string(list_transform(range(1, least(named, 5) + 1), lambda i: 't' || i), ', ') || CASE WHEN named > 5 THEN ' (+ ' || (named - 5) || ' more)' ELSE '' END END AS tool_summary,
  NOT lost OR NOT bad AS tools_listable, NOT lost OR id % 6 > 0 AS prompts_listable,
  CASE WHEN bad THEN NULL ELSE array_to_string(list_transform(range(1, named + 1), lambda i: 't' || i), ',') END AS tools,
  array_to_string(list_transform(list_filter(range(1, n % 13 + 2), lambda i: i <> 2), lambda i: 'file:///r' || i), ',') AS resources,
  CASE WHEN id % 6 > 0 THEN 'p1,p2,p3,p4' END AS prompts FROM t""")
def probe_verdicts(spark, d):
    return probes.verdicts(_probe_log(spark, d)).select(
        "id", "status", "tool_count", "tool_summary", "tools_listable", "prompts_listable",
        F.array_join("tools.name", ",").alias("tools"), F.array_join("resources.uri", ",").alias("resources"),
        F.array_join("prompts.name", ",").alias("prompts"))
