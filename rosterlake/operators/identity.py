"""Protocol-identity detector: sixteen checks, one status ladder, role lists."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sqltext as S
from ..functions.arrays import computed_once
from ..rules import classes as W
from . import classify as C, evidence as E


def _code_item(rule, matched: str, score, confidence) -> str:
    return S.evidence("source_code", "repository_source", rule, matched, confidence, score)


def _package_entry() -> str:
    """First executable-entry evidence over package files in name order."""
    manifest = lambda label: S.evidence("package_manifest", "(f.key)", "executable_entrypoint", S.quote(label), 0.8, 10)
    entry = S.ladder((
        (S.any_of("f.value", W.EXECUTABLE_MARKS), manifest("bin entrypoint")),
        (S.any_of("f.value", (W.EXECUTABLE_MAIN,)),
         S.evidence("source_code", "(f.key)", "executable_entrypoint", "'package main'", 0.8, 10)),
        (f"{S.any_of('f.key', ('setup.py', 'pyproject.toml'))} AND "
         f"{S.any_of('f.value', ('entry_points', 'console_scripts'))}", manifest("entry_points/console_scripts")),
        (f"contains(f.key, 'Cargo.toml') AND {S.any_of('f.value', ('[[bin]]', 'crate-type'))}",
         manifest("Cargo.toml bin"))), "NULL")
    return f"slice(array_compact(transform(array_sort(map_entries(package_files)), f -> {entry})), 1, 1)"


def _checks() -> dict:
    """name -> evidence array as SQL text; a check holds when it is not empty."""
    code = lambda ws: S.any_of("_code", ws)
    token = lambda words, rule, score, conf: S.when(
        code(words), _code_item(rule, S.first_of("_code", words), score, conf))
    otherwise = lambda cond, item, rest: f"IF({cond}, array({item}), {rest})"
    runtime = "exists(endpoints, e -> e.type = 'MCP_RUNTIME_ENDPOINT')"
    documents = "exists(endpoints, e -> e.type IN ('DOCUMENTATION_URL', 'INSTALLER_URL', 'REPOSITORY_URL'))"
    package = "exists(_packages, p -> contains(p, 'modelcontextprotocol'))"
    plain_package = "exists(_packages, p -> contains(p, 'modelcontextprotocol') AND NOT contains(p, 'sdk'))"
    mcp_topic, sdk_topic = C.in_topics(("mcp",)), C.in_topics(("sdk",))
    first_topic = lambda w: f"get(filter(_topics_low, t -> contains(t, {S.quote(w)})), 0)"
    topic_item = lambda rule, w, conf: S.evidence("repository_topics", "github_topics", rule, first_topic(w), conf, 5)
    manifest = lambda rule, matched, conf, score: S.evidence(
        "package_manifest", "package_manifest", rule, S.quote(matched), conf, score)

    imports = [(i, conf) for group, conf in ((W.IMPORTS_GO, 0.95), (W.IMPORTS_JS, 0.95), (W.IMPORTS_PY, 0.9))
               for i in group]
    host_struct = f"{code((W.ID_HOST_STRUCT,))} AND {code(W.ID_HOST_STRUCT_PARTS)}"
    tutorial = S.first_of("concat_ws('\\n', _name_low, _desc_low, _readme_low)", W.ID_TUTORIAL_WORDS)
    collection = S.first_of("concat_ws('\\n', _name_low, _desc_low)", W.COLLECTION_WORDS)
    readme_only = f"NOT {S.any_of('_readme_low', W.ID_CODE_WORDS)} AND {S.any_of('_readme_low', W.ID_README_WORDS)}"
    repo_item = lambda rule, word, conf: S.evidence("repository_metadata", "github_repo", rule, word, conf, -10)

    return {
        "import": "concat(" + ", ".join(
            S.when(code((i,)), _code_item("mcp_import", S.quote(i), 10, conf)) for i, conf in imports) + ")",
        "server_impl": token(W.ID_SERVER_IMPL, "mcp_server_impl", 15, 0.9),
        "transport": f"IF({code(W.ID_TRANSPORTS)}, {token(W.ID_TRANSPORTS, 'mcp_transport', 15, 0.95)}, "
                     + S.when(runtime, S.evidence("mcp_protocol", "endpoints", "mcp_runtime_endpoint",
                                                  "'MCP_RUNTIME_ENDPOINT'", 1.0, 20)) + ")",
        "tool_defs": f"IF({code(W.ID_TOOL_DEFS)}, {token(W.ID_TOOL_DEFS, 'tool_definitions', 10, 0.9)}, "
                     + S.when("size(tools) > 0", S.evidence("mcp_protocol", "tools_list", "tool_definitions",
                                                            "'tools list populated'", 0.85, 10)) + ")",
        "executable": _package_entry(),
        "dependency": otherwise(package, manifest("mcp_dependency", "modelcontextprotocol", 0.8, 5), otherwise(
            mcp_topic, topic_item("mcp_topic", "mcp", 0.7),
            token(tuple(i for i, _ in imports), "mcp_import", 10, 0.9))),
        "client": S.when(code(W.ID_CLIENT_IMPL), _code_item("mcp_client_impl", "'McpClient'", 10, 0.9)),
        "host": otherwise(code(W.HOST_IMPL), _code_item("mcp_host_impl", "'McpHost'", 10, 0.9), S.when(
            host_struct, _code_item("mcp_host_impl", "'Host struct with client management'", 10, 0.9))),
        "sdk": otherwise(C.in_packages(W.SDK_PACKAGES),
                         manifest("mcp_sdk_dependency", "@modelcontextprotocol/sdk", 0.95, 10),
                         S.when(sdk_topic, topic_item("mcp_sdk_topic", "sdk", 0.8))),
        "library": S.when(f"NOT {sdk_topic} AND ({plain_package} OR {mcp_topic})",
                          manifest("mcp_library_dependency", "modelcontextprotocol (no sdk)", 0.8, 5)),
        "extension": S.when(code(W.ID_EXTENSION_IMPL), _code_item("mcp_extension_impl", "'McpExtension'", 10, 0.9)),
        "skill": S.when(code(W.ID_SKILL_IMPL), _code_item("mcp_skill_impl", "'McpSkill'", 10, 0.9)),
        "readme_only": S.when(readme_only, S.evidence("readme", "README", "only_readme_mention",
                                                      "'MCP mentioned in README'", 0.7, -5)),
        "tutorial": S.when(f"({tutorial}) IS NOT NULL", repo_item("tutorial_or_example", tutorial, 0.8)),
        "collection": otherwise(f"({collection}) IS NOT NULL", repo_item("collection_or_registry", collection, 0.85),
                                S.when(C.MANY_LINKS_SQL, S.evidence("readme", "README", "many_repo_links",
                                                                    "'Multiple github.com links'", 0.7, -5))),
        "doc_only": S.when(f"{documents} AND NOT {runtime}", S.evidence(
            "endpoint", "endpoints", "only_doc_endpoint", "'Only documentation/installer endpoints'", 0.8, -5)),
    }


def detect(df: DataFrame, out="identity") -> DataFrame:
    """Adds struct<status, role, secondary_roles, confidence, evidence>."""
    checks = _checks()
    held = {k: f"size(_checks.`{k}`) > 0" for k in checks}
    server = f"({held['transport']} AND ({held['tool_defs']} OR {held['executable']}) AND {held['server_impl']})"
    ladder = (
        (f"{held['tutorial']} OR {held['collection']}", "NOT_MCP", "NONE"),
        (server, "STATIC_VERIFIED", "SERVER"),
        (held["host"], "STATIC_VERIFIED", "HOST"),
        (held["client"], "STATIC_VERIFIED", "CLIENT"),
        (held["sdk"], "STATIC_VERIFIED", "SDK"),
        (held["extension"], "STATIC_VERIFIED", "EXTENSION"),
        (held["skill"], "STATIC_VERIFIED", "SKILL"),
        (held["library"], "STATIC_VERIFIED", "LIBRARY"),
        (held["dependency"], "CANDIDATE", "NONE"),
    )
    secondary = ", ".join(f"IF({cond}, '{role}', NULL)" for cond, role in (
        (held["sdk"], "SDK"), (held["extension"], "EXTENSION"), (held["skill"], "SKILL"),
        (held["library"], "LIBRARY"), (held["client"], "CLIENT"), (held["host"], "HOST"), (server, "SERVER")))
    return (C.prepare(df).withColumn("_readme_low", F.lower("raw_content"))
            .withColumn("_checks", F.expr("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in checks.items()) + ")"))
            .withColumn("_id_evidence", F.expr("concat(" + ", ".join(f"_checks.`{k}`" for k in checks) + ")"))
            .transform(computed_once, out, F.struct(
                F.expr(S.ladder([(c, f"'{s}'") for c, s, _ in ladder], "'NOT_MCP'")).alias("status"),
                F.expr(S.ladder([(c, f"'{r}'") for c, _, r in ladder], "'NONE'")).alias("role"),
                F.expr(f"array_compact(array({secondary}))").alias("secondary_roles"),
                E.score_weighted_confidence(F.col("_id_evidence")).alias("confidence"),
                F.col("_id_evidence").alias("evidence")))
            .drop("_checks", "_id_evidence", *C._DERIVED))


def shortcut_status(primary: Column) -> Column:
    """Two-way form of the live pipeline: servers are statically verified."""
    return F.when(primary == "MCP_SERVER", "STATIC_VERIFIED").otherwise("NOT_MCP")
