"""Ordered classification, identity, heuristics, endpoints, review."""

from pyspark.sql import functions as F

from ..operators import classify as C, endpoints as EP, identity, relevance as R, review
from ..rules import classes as W, patterns, vocab
from . import bindings as B
from .book import query
from .q_relevance import AI, AI_SQL, REGION, REGION_SQL

_A = B.any_sql


def scored_entities(spark, d):
    """Entities with region and AI scores as plain columns."""
    df = R.add(R.add(B.doc_entities(spark, d), "_r", R.region(REGION)), "_a", R.ai(AI))
    return (df.withColumns({"region_score": F.col("_r.score"), "region_level": F.col("_r.level"),
                            "ai_score": F.col("_a.score"), "ai_level": F.col("_a.level")}).drop("_r", "_a")
            .withColumn("identity_status", F.when(F.col("doc_id") % 17 == 0, "RUNTIME_VERIFIED").otherwise("CANDIDATE")))


def _n(*conds):
    return "(" + " + ".join(f"CAST({c} AS INT)" for c in conds) + ")"


def _topic(words):
    return f"(len(list_filter(topics, lambda t: {_A('lower(t)', words)})) > 0)"


_name = lambda ws: f"({_A('lower(repo_name)', ws)} OR {_A('lower(description)', ws)})"
_pkg = lambda ws: f"coalesce({_A('pkg', ws)}, FALSE)"
_claims = _A("lower(description)", W.SERVER_CLAIMS)
_impl, _stdio, _tooldef = _A("code", W.SERVER_IMPL), _A("code", W.STDIO_TRANSPORT), _A("code", W.TOOL_DEFS)
_exec_bin, _exec_main = _pkg(W.EXECUTABLE_MARKS), _pkg((W.EXECUTABLE_MAIN,))
_exec = f"({_exec_bin} OR {_exec_main})"
_runtime = "identity_status = 'RUNTIME_VERIFIED'"
_client = _A("code", W.CLIENT_IMPL)
_links = "len(string_split(raw_content, 'github.com/')) > 11"
_agent_tool = (f"len(list_filter(tools, lambda t: {_A('lower(t.description)', ('agent', 'autonomous', 'plan'))} "
               "OR contains(lower(t.name), 'agent'))) > 0")
_coll_topics = f"len(list_filter(topics, lambda t: {_A('lower(t)', W.COLLECTION_WORDS)}))"
_fw_pkg = f"coalesce({_A('lower(pkg)', W.FRAMEWORK_WORDS)}, FALSE)"
_ds = "ds_type IN (" + ", ".join(B.quote(x) for x in W.DATASET_SOURCE_TYPES) + ")"
_few = "len(tools) BETWEEN 1 AND 5"
_tool_code = _A("code", W.TOOL_IMPL)
_agent_code = _A("code", W.AGENT_IMPL)
_sdk_pkg = _pkg(W.SDK_PACKAGES)
_library = ("(coalesce(contains(pkg, 'modelcontextprotocol') AND NOT contains(pkg, 'sdk'), FALSE) OR "
            "len(list_filter(topics, lambda t: contains(lower(t), 'mcp') AND NOT contains(lower(t), 'sdk'))) > 0)")


def _mean(*pairs):
    """Mean confidence over the evidence present: (count expression, confidence)."""
    num = " + ".join(f"{c} * {v}" for c, v in pairs)
    den = " + ".join(c for c, _ in pairs)
    return f"({num}) / ({den})"


_b = lambda cond: f"CAST({cond} AS INT)"
# (class, role, condition, confidence) in order
_LADDER = [
    ("AI_DATASET", "NONE", f"NOT {_claims} AND ({_A('lower(description)', W.DATA_LIBRARY_PHRASES)} OR {_A('lower(name)', W.DATA_LIBRARY_NAMES)})", "0.1"),
    ("AI_INFRASTRUCTURE", "NONE", f"NOT {_claims} AND ({_A('lower(description)', W.DATA_INFRA_PHRASES)} OR len(list_filter(topics, lambda t: lower(t) IN ({', '.join(map(B.quote, W.DATA_INFRA_TOPICS))}))) > 0)", "0.1"),
    ("MCP_SERVER", "SERVER", f"{_runtime} OR {_n(_impl, _stdio, _tooldef, _exec)} >= 2",
     _mean((_b(_impl), 0.9), (_b(_stdio), 0.85), (_b(_tooldef), 0.9), (_b(_exec), 0.8), (_b(_runtime), 1.0))),
    ("MCP_CLIENT", "CLIENT", f"{_client} AND NOT {_A('code', W.CLIENT_BLOCKERS)}", "0.9"),
    ("MCP_HOST", "HOST", _A("code", W.HOST_IMPL), "0.9"),
    ("MCP_SDK", "SDK", f"{_sdk_pkg} OR {_topic(W.SDK_TOPICS)}", f"CASE WHEN {_sdk_pkg} THEN 0.95 ELSE 0.8 END"),
    ("MCP_LIBRARY", "LIBRARY", _library, "0.8"),
    ("MCP_EXTENSION", "EXTENSION", _A("code", W.EXTENSION_IMPL), "0.9"),
    ("MCP_SKILL", "SKILL", _A("code", W.SKILL_IMPL), "0.9"),
    ("MCP_COLLECTION", "NONE", f"{_name(W.COLLECTION_WORDS)} OR {_coll_topics} > 0 OR {_links}",
     _mean((_b(_name(W.COLLECTION_WORDS)), 0.85), (_coll_topics, 0.8), (_b(_links), 0.7))),
    ("AI_AGENT", "NONE", f"{_agent_code} OR {_agent_tool}",
     _mean((_b(_agent_code), 0.85), (_b(_agent_tool), 0.8), (_b("ai_score >= 50"), 0.7))),
    ("AI_TOOL", "NONE", f"{_tool_code} OR {_few}", f"CASE WHEN {_tool_code} THEN 0.85 ELSE 0.75 END"),
    ("AI_SDK", "NONE", f"coalesce({_A('lower(pkg)', W.AI_SDK_PACKAGES)}, FALSE)", "0.9"),
    ("AI_FRAMEWORK", "NONE", f"{_topic(W.FRAMEWORK_WORDS)} OR {_fw_pkg}", f"CASE WHEN {_topic(W.FRAMEWORK_WORDS)} THEN 0.85 ELSE 0.9 END"),
    ("AI_SKILL", "NONE", f"contains(code, 'Skill') AND {_A('code', W.AI_SKILL_FORMS)}", "0.85"),
    ("AI_KNOWLEDGE_BASE", "NONE", f"{_topic(W.KNOWLEDGE_WORDS)} OR {_A('lower(description)', W.KNOWLEDGE_WORDS)}", f"CASE WHEN {_topic(W.KNOWLEDGE_WORDS)} THEN 0.85 ELSE 0.75 END"),
    ("AI_DATASET", "NONE", f"{_ds} OR {_topic(W.DATASET_WORDS)}", f"CASE WHEN {_ds} THEN 0.9 ELSE 0.8 END"),
    ("AI_API", "NONE", f"{_A('lower(code)', W.API_WORDS)} AND ai_score > 15", "0.75"),
    ("AI_APPLICATION", "NONE", f"{_name(W.APPLICATION_WORDS)} AND ai_score > 10", "0.8"),
    ("AI_INFRASTRUCTURE", "NONE", f"{_topic(W.INFRA_WORDS)} AND ai_score > 10", "0.85"),
    ("AI_PLUGIN", "NONE", f"{_A('lower(code)', W.PLUGIN_WORDS)} AND contains(code, 'AI')", "0.8"),
    ("AI_TUTORIAL", "NONE", f"{_name(W.TUTORIAL_WORDS)} OR {_A('lower(raw_content)', W.TUTORIAL_WORDS)}", "0.8"),
    ("AI_EXAMPLE", "NONE", _name(W.EXAMPLE_WORDS), "0.8"),
    ("AI_COLLECTION", "NONE", f"{_name(W.AI_COLLECTION_WORDS)} AND ai_score > 15", "0.85"),
    ("AI_REGISTRY", "NONE", _name(W.REGISTRY_WORDS), "0.85"),
    ("AI_RELATED_PROJECT", "NONE", "ai_score > 5", "0.7"),
    ("NON_AI_PROJECT", "NONE", "ai_score = 0 AND region_score = 0", "1.0"),
]


def _ladder_sql(i, default):
    return "CASE " + " ".join(f"WHEN {r[2]} THEN {r[i] if i == 3 else B.quote(r[i])}" for r in _LADDER) + f" ELSE {default} END"


SCORED = f"""{B.ENTS}, scored AS (SELECT *, CAST({REGION_SQL} AS DOUBLE) AS region_score, CAST({AI_SQL} AS DOUBLE) AS ai_score,
  description || chr(10) || raw_content || coalesce(chr(10) || pkg, '') AS code,
  CASE WHEN doc_id % 17 = 0 THEN 'RUNTIME_VERIFIED' ELSE 'CANDIDATE' END AS identity_status FROM ents)"""
CLASSIFIED = f"""{SCORED}, classified AS (SELECT *, {_ladder_sql(0, "'UNKNOWN'")} AS primary_class,
  {_ladder_sql(1, "'NONE'")} AS role, round(CAST({_ladder_sql(3, '0.1')} AS DOUBLE), 6) AS class_confidence FROM scored)"""


@query("primary_class", f"WITH {CLASSIFIED} SELECT id, primary_class, role, class_confidence AS confidence FROM classified")
def primary_class(spark, d):
    df = C.classify(scored_entities(spark, d))
    c = F.col("classification")
    return df.select("id", c["primary"].alias("primary_class"), c["role"].alias("role"),
                     F.round(c["confidence"], 6).alias("confidence"))


@query("class_with_leaky_evidence", f"""WITH {CLASSIFIED}
SELECT primary_class, count(*) AS entities FROM classified GROUP BY 1""")
def class_with_leaky_evidence(spark, d):
    """Evidence mode changes confidences, never the class."""
    df = C.classify(scored_entities(spark, d), leaky_evidence=True)
    return df.groupBy(F.col("classification.primary").alias("primary_class")).agg(F.count("*").alias("entities"))


# --- identity --------------------------------------------------------------------------

_RT = "len(list_filter(endpoints, lambda e: e.type = 'MCP_RUNTIME_ENDPOINT')) > 0"
_T = {
    "import_": None,
    "server_impl": _A("code", W.ID_SERVER_IMPL),
    "transport": f"({_A('code', W.ID_TRANSPORTS)} OR {_RT})",
    "tool_defs": f"({_A('code', W.ID_TOOL_DEFS)} OR len(tools) > 0)",
    "executable": f"coalesce(({_A('pkg', W.EXECUTABLE_MARKS)} OR contains(pkg, 'package main') OR "
                  f"({_A('pkg_file', ('setup.py', 'pyproject.toml'))} AND {_A('pkg', ('entry_points', 'console_scripts'))})), FALSE)",
    "dependency": f"(coalesce(contains(pkg, 'modelcontextprotocol'), FALSE) OR {_topic(('mcp',))} OR "
                  f"{_A('code', W.IMPORTS_GO + W.IMPORTS_JS + W.IMPORTS_PY)})",
    "client": _A("code", W.ID_CLIENT_IMPL),
    "host": f"({_A('code', W.HOST_IMPL)} OR (contains(code, '{W.ID_HOST_STRUCT}') AND {_A('code', W.ID_HOST_STRUCT_PARTS)}))",
    "sdk": f"({_sdk_pkg} OR {_topic(('sdk',))})",
    "library": f"(NOT {_topic(('sdk',))} AND (coalesce(contains(pkg, 'modelcontextprotocol') AND NOT contains(pkg, 'sdk'), FALSE) OR {_topic(('mcp',))}))",
    "extension": _A("code", W.ID_EXTENSION_IMPL),
    "skill": _A("code", W.ID_SKILL_IMPL),
    "readme_only": f"(NOT {_A('lower(raw_content)', W.ID_CODE_WORDS)} AND {_A('lower(raw_content)', W.ID_README_WORDS)})",
    "tutorial": f"({_name(W.ID_TUTORIAL_WORDS)} OR {_A('lower(raw_content)', W.ID_TUTORIAL_WORDS)})",
    "coll_names": _name(W.COLLECTION_WORDS),
    "links": _links,
    "doc_only": f"(len(list_filter(endpoints, lambda e: e.type IN ('DOCUMENTATION_URL', 'INSTALLER_URL', 'REPOSITORY_URL'))) > 0 AND NOT {_RT})",
}
_IMPORTS = [(w, 0.95) for w in W.IMPORTS_GO + W.IMPORTS_JS] + [(w, 0.9) for w in W.IMPORTS_PY]
# (condition, weight, confidence) of each evidence item
_EV = [(f"contains(code, {B.quote(w)})", 10, c) for w, c in _IMPORTS] + [
    ("server_impl", 15, 0.9), (f"transport AND {_A('code', W.ID_TRANSPORTS)}", 15, 0.95),
    (f"transport AND NOT {_A('code', W.ID_TRANSPORTS)}", 20, 1.0),
    (f"tool_defs AND {_A('code', W.ID_TOOL_DEFS)}", 10, 0.9), (f"tool_defs AND NOT {_A('code', W.ID_TOOL_DEFS)}", 10, 0.85),
    ("executable", 10, 0.8), ("coalesce(contains(pkg, 'modelcontextprotocol'), FALSE)", 5, 0.8),
    (f"NOT coalesce(contains(pkg, 'modelcontextprotocol'), FALSE) AND {_topic(('mcp',))}", 5, 0.7),
    (f"dependency AND NOT coalesce(contains(pkg, 'modelcontextprotocol'), FALSE) AND NOT {_topic(('mcp',))}", 10, 0.9),
    ("client", 10, 0.9), ("host", 10, 0.9), (f"{_sdk_pkg}", 10, 0.95), (f"sdk AND NOT {_sdk_pkg}", 5, 0.8),
    ("library", 5, 0.8), ("extension", 10, 0.9), ("skill", 10, 0.9), ("readme_only", 5, 0.7), ("tutorial", 5, 0.8),
    ("coll_names", 5, 0.85), ("links AND NOT coll_names", 5, 0.7), ("doc_only", 5, 0.8)]
_NUM = " + ".join(f"CASE WHEN {c} THEN {w * v} ELSE 0 END" for c, w, v in _EV)
_DEN = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in _EV)
_SERVER = "(transport AND (tool_defs OR executable) AND server_impl)"


@query("identity", f"""WITH {SCORED}, t AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _T.items() if v)} FROM scored),
w AS (SELECT *, CAST({_NUM} AS DOUBLE) AS num, CAST({_DEN} AS DOUBLE) AS den FROM t)
SELECT id, CASE WHEN tutorial OR coll_names OR links THEN 'NOT_MCP'
    WHEN {_SERVER} OR host OR client OR sdk OR extension OR skill OR library THEN 'STATIC_VERIFIED'
    WHEN dependency THEN 'CANDIDATE' ELSE 'NOT_MCP' END AS status,
  CASE WHEN tutorial OR coll_names OR links THEN 'NONE' WHEN {_SERVER} THEN 'SERVER' WHEN host THEN 'HOST' WHEN client THEN 'CLIENT'
    WHEN sdk THEN 'SDK' WHEN extension THEN 'EXTENSION' WHEN skill THEN 'SKILL' WHEN library THEN 'LIBRARY' ELSE 'NONE' END AS role,
  array_to_string(list_filter([CASE WHEN sdk THEN 'SDK' END, CASE WHEN extension THEN 'EXTENSION' END, CASE WHEN skill THEN 'SKILL' END,
    CASE WHEN library THEN 'LIBRARY' END, CASE WHEN client THEN 'CLIENT' END, CASE WHEN host THEN 'HOST' END,
    CASE WHEN {_SERVER} THEN 'SERVER' END], lambda r: r IS NOT NULL), ',') AS roles,
  round(CASE WHEN den > 0 THEN least(greatest(num / den, 0.1), 1.0) ELSE 0.1 END, 6) AS confidence FROM w""")
def identity_query(spark, d):
    df = identity.detect(scored_entities(spark, d))
    i = F.col("identity")
    return df.select("id", i["status"].alias("status"), i["role"].alias("role"),
                     F.array_join(i["secondary_roles"], ",").alias("roles"),
                     F.round(i["confidence"], 6).alias("confidence"))


# --- ordered rules, heuristics ----------------------------------------------------------

_NAME_RULES = (("AI_TUTORIAL", ("src1-",)), ("AI_SDK", ("-de-", "src2-")), ("AI_TOOL", ("9",)))
_TEXT_RULES = (("AI_AGENT", ("ing the", "que ")), ("AI_DATASET", ("und", "tion ")))


@query("heuristic_class", f"""WITH {B.ENTS} SELECT id, CASE {' '.join(f"WHEN {_A('lower(name)', w)} THEN '{c}'" for c, w in _NAME_RULES)}
  {' '.join(f"WHEN {_A('(lower(name) || chr(32) || lower(description))', w)} THEN '{c}'" for c, w in _TEXT_RULES)} ELSE 'MCP_SERVER' END AS primary_class
FROM ents""")
def heuristic_class(spark, d):
    return B.doc_entities(spark, d).select("id", C.heuristic_class(
        F.col("name"), F.col("description"), _NAME_RULES, _TEXT_RULES).alias("primary_class"))


@query("review_routing", f"""WITH {CLASSIFIED} SELECT id, class_confidence < 0.7 OR (region_score BETWEEN 20 AND 55 AND ai_score BETWEEN 20 AND 55) AS needs_review,
  region_score BETWEEN 20 AND 55 AS needs_legacy_review FROM classified""")
def review_routing(spark, d):
    df = C.classify(scored_entities(spark, d))
    return df.select(
        "id", C.needs_review(F.round("classification.confidence", 6), F.col("region_score"), F.col("ai_score"))
        .alias("needs_review"), C.needs_review_legacy(F.col("region_score")).alias("needs_legacy_review"))


_ANSWER_CLASS = ("AI_AGENT", "NOT_A_CLASS", "AI_TOOL")
_ANSWER_ROLE = ("", "SERVER", "BOSS", "CLIENT")


def review_answers(spark, d):
    """Two landed answers per document, some of them invalid or broken."""
    n, m = F.col("doc_id"), F.col("model_order")
    docs = B.table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.array(F.lit(1), F.lit(2))).alias("model_order"))
    doc = F.to_json(F.struct(
        B._pick(_ANSWER_CLASS, n + m).alias("classification"), ((n + m) % 5 / 10.0).alias("confidence"),
        F.array(F.lit("seen")).alias("evidence"), B._pick(_ANSWER_ROLE, n).alias("mcp_role")))
    return docs.select(n.cast("string").alias("id"), "model_order",
                       F.when((n + m) % 7 == 0, "{broken").otherwise(doc).alias("answer"))


@query("review_merge", f"""WITH {CLASSIFIED},
a AS (SELECT CAST(doc_id AS VARCHAR) AS id, m, {B.sql_pick(_ANSWER_CLASS, 'doc_id + m')} AS cls, (doc_id + m) % 5 / 10.0 AS conf,
   {B.sql_pick(_ANSWER_ROLE, 'doc_id')} AS arole, (doc_id + m) % 7 = 0 AS broken FROM documents, (VALUES (1), (2)) v(m)),
best AS (SELECT id, cls, conf, arole, row_number() OVER (PARTITION BY id ORDER BY m) AS rn FROM a
   WHERE NOT broken AND conf > 0 AND cls <> 'NOT_A_CLASS' AND arole <> 'BOSS')
SELECT c.id, coalesce(b.cls, c.primary_class) AS primary_class, CASE WHEN b.id IS NOT NULL AND arole <> '' THEN arole ELSE c.role END AS role,
  round(CAST(coalesce(b.conf, c.class_confidence) AS DOUBLE), 6) AS confidence
FROM classified c LEFT JOIN best b ON b.id = c.id AND b.rn = 1""")
def review_merge(spark, d):
    df = C.classify(scored_entities(spark, d)).select("id", "classification")
    merged = review.merge(df, review_answers(spark, d))
    c = F.col("classification")
    return merged.select("id", c["primary"].alias("primary_class"), c["role"].alias("role"),
                         F.round(c["confidence"], 6).alias("confidence"))


@query("review_merge_region", f"""WITH {SCORED},
a AS (SELECT CAST(doc_id AS VARCHAR) AS id, m, {B.sql_pick(('T3', 'T9', 'T5'), 'doc_id + m')} AS lvl, (doc_id + m) % 3 / 10.0 AS conf,
  10.0 * m AS sc FROM documents, (VALUES (1), (2)) v(m)),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m) AS rn FROM a WHERE conf > 0 AND lvl <> 'T9')
SELECT s.id, CASE WHEN region_score BETWEEN 20 AND 55 THEN coalesce(b.lvl, 'T2') ELSE {B.band_sql('region_score', vocab.REGION_BANDS, 'T0')} END AS region_level,
  CAST(CASE WHEN region_score BETWEEN 20 AND 55 THEN coalesce(b.sc, 35) ELSE region_score END AS DOUBLE) AS region_score,
  CAST(CASE WHEN region_score BETWEEN 20 AND 55 THEN coalesce(b.conf, 0.5) ELSE 1 END AS DOUBLE) AS region_confidence
FROM scored s LEFT JOIN best b ON b.id = s.id AND rn = 1""")
def review_merge_region(spark, d):
    n, m = F.col("doc_id"), F.col("model_order")
    docs = B.table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("model_order"))
    answers = docs.select(n.cast("string").alias("id"), "model_order", F.to_json(F.struct(
        B._pick(("T3", "T9", "T5"), n + m).alias("taiwan_relevance"), (m * 10.0).alias("score"),
        ((n + m) % 3 / 10.0).alias("confidence"))).alias("answer"))
    rows = scored_entities(spark, d).select("id", "region_score")
    return review.merge_region(rows, answers).select("id", "region_level", "region_score", "region_confidence")


# --- endpoints --------------------------------------------------------------------------

_HINT = _A("lower(raw_content)", patterns.RUNTIME_HINTS)
_EMB = r"""list_transform(regexp_extract_all(raw_content, 'https?://[^\s<>"{}|\\^`\[\]]+'), lambda u: rtrim(u, '.,;:)]}>'))"""
_LOOKS = ("(" + " OR ".join(f"starts_with(lower(url), '{p}')" for p in patterns.RUNTIME_PREFIXES)
          + f" OR (starts_with(lower(url), 'https://') AND {_A('lower(url)', patterns.RUNTIME_PATHS)}))")
_KINDS = ("DOCUMENTATION_URL", "INSTALLER_URL", "REPOSITORY_URL", "HOMEPAGE_URL", "MCP_RUNTIME_ENDPOINT")
_SUMS = {k: " + ".join([f"CASE WHEN regexp_matches(lower(url), {B.quote(r.pattern)}) THEN {r.confidence} ELSE 0 END"
                        for r in patterns.URL_RULES if r.type == k] or ["0"]) for k in _KINDS}
_SUMS["HOMEPAGE_URL"] = "CASE WHEN homepage <> '' AND lower(url) = lower(homepage) THEN 0.9 ELSE 0 END"
_SUMS["MCP_RUNTIME_ENDPOINT"] = f"CASE WHEN hint AND {_LOOKS} THEN 0.4 ELSE 0 END"
URLS_SQL = f"""u0 AS (SELECT id, doc_id, homepage, {_HINT} AS hint, unnest(
    list_concat(list_concat(list_transform(endpoints, lambda e: struct_pack(url := e.url, origin := 'endpoint')),
      [struct_pack(url := repo_url, origin := 'repository_info'), struct_pack(url := homepage, origin := 'repository_info')]),
      list_transform({_EMB}, lambda u: struct_pack(url := u, origin := 'raw_content')))) AS s,
    generate_subscripts(list_concat(list_concat(list_transform(endpoints, lambda e: e.url), [repo_url, homepage]), {_EMB}), 1) AS pos FROM ents),
u1 AS (SELECT id, doc_id, homepage, hint, s.url AS url, s.origin AS origin, pos,
   row_number() OVER (PARTITION BY id, s.url ORDER BY pos) AS rn FROM u0),
u2 AS (SELECT *, {', '.join(f'round({v}, 6) AS s{i}' for i, v in enumerate(_SUMS.values()))} FROM u1 WHERE rn = 1),
typed AS (SELECT id, doc_id, url, origin, pos, greatest(s0, s1, s2, s3, s4) AS top, CASE WHEN greatest(s0, s1, s2, s3, s4) = 0 THEN 'UNKNOWN'
   {' '.join(f"WHEN s{i} = greatest(s0, s1, s2, s3, s4) THEN '{k}'" for i, k in enumerate(_KINDS))} END AS type,
   CASE WHEN greatest(s0, s1, s2, s3, s4) = 0 THEN 0.1 ELSE least(greatest(s0, s1, s2, s3, s4), 1.0) END AS confidence FROM u2)"""


@query("endpoint_types", f"WITH {B.ENTS}, {URLS_SQL} SELECT id, url, origin, type, CAST(confidence AS DOUBLE) AS confidence FROM typed")
def endpoint_types(spark, d):
    return EP.classify(EP.collect(B.doc_entities(spark, d))).select("id", "url", "origin", "type", "confidence")


@query("page_url_types", f"""WITH u2 AS (SELECT page_id, url, {_SUMS['DOCUMENTATION_URL'].replace('regexp_matches(lower(url)', 'regexp_matches(lower(url)')} AS s0,
  {_SUMS['INSTALLER_URL']} AS s1, {_SUMS['REPOSITORY_URL']} AS s2,
  CASE WHEN regexp_matches(url, '\\.html$') THEN 0.9 ELSE 0 END AS s3 FROM pages)
SELECT CASE WHEN s0 + s1 + s2 + s3 = 0 THEN 'UNKNOWN' WHEN s0 >= greatest(s1, s2, s3) THEN 'DOCUMENTATION_URL'
  WHEN s1 >= greatest(s2, s3) THEN 'INSTALLER_URL' WHEN s2 >= s3 THEN 'REPOSITORY_URL' ELSE 'PAGE' END AS type, count(*) AS urls
FROM u2 GROUP BY 1""")
def page_url_types(spark, d):
    rules = patterns.URL_RULES + (patterns.UrlRule("PAGE", "html_page", 0.9, r"\.html$"),)
    ballots = EP.votes("url", "''", "false", rules)
    kinds = ("DOCUMENTATION_URL", "INSTALLER_URL", "REPOSITORY_URL", "PAGE")
    typed = B.table(spark, d, "pages").select("page_id", "url").withColumn("v", ballots)
    return typed.groupBy(EP.decide(F.col("v"), kinds)["type"].alias("type")).agg(F.count("*").alias("urls"))


@query("runtime_endpoints", f"""WITH {B.ENTS}, {URLS_SQL},
passed AS (SELECT id FROM ents WHERE language = 'en'),
firsts AS (SELECT t.id, min(CASE WHEN type = 'MCP_RUNTIME_ENDPOINT' THEN pos END) AS rt, min(CASE WHEN origin = 'endpoint' THEN pos END) AS ls
   FROM typed t JOIN passed p ON p.id = t.id GROUP BY t.id),
m AS (SELECT t.id, url, type, CASE WHEN pos = rt THEN 1.0 ELSE confidence END AS confidence FROM typed t LEFT JOIN firsts f ON f.id = t.id
  UNION ALL SELECT t.id, url, 'MCP_RUNTIME_ENDPOINT', 1.0 FROM typed t JOIN firsts f ON f.id = t.id WHERE rt IS NULL AND pos = ls)
SELECT id, url, CAST(confidence AS DOUBLE) AS confidence FROM m WHERE type = 'MCP_RUNTIME_ENDPOINT' AND confidence > 0.5""")
def runtime_endpoints(spark, d):
    ents = B.doc_entities(spark, d)
    typed = EP.classify(EP.collect(ents))
    passed = ents.filter(F.col("language") == "en")
    return EP.runtime_endpoints(EP.runtime_override(typed, passed)).select("id", "url", "confidence")
