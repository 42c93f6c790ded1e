"""Ordered rule classifier.

A rule is (class, role, condition, evidence).  The first rule whose condition
holds wins; Spark's CASE WHEN evaluates conditions in order and stops, so later
rules cost nothing for rows that are already decided.
"""

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import regex, sqltext as S
from ..functions.arrays import computed_once
from ..rules import classes as W, vocab
from . import evidence as E


class Rule(NamedTuple):
    name: str
    label: str
    role: str
    condition: str
    evidence: str


def first_true(rules, default):
    """CASE over ordered (condition, value) pairs."""
    head, *tail = rules
    expr = F.when(head[0], head[1])
    for cond, value in tail:
        expr = expr.when(cond, value)
    return expr.otherwise(default)


def prepare(df: DataFrame) -> DataFrame:
    """Derived texts every rule reads, computed once per row."""
    return (df
            .withColumns({"_packages": F.map_values("package_files"),
                          "_topics_low": F.expr("transform(topics, t -> lower(t))"),
                          "_name_low": F.lower("repo_name"), "_desc_low": F.lower("description")})
            .withColumns({"_code": F.expr("concat_ws('\\n', description, raw_content, array_join(_packages, '\\n'))"),
                          "_packages_low": F.expr("transform(_packages, p -> lower(p))")})
            .withColumn("_joined", F.col("_code").rlike(_JOINT)))


# a capital right behind a small letter or a dot: most code words have one, prose hardly ever
_JOINT = "[a-z.][A-Z]"
# whole texts in small letters, for rows that the rules before those that read them leave open
_LATE = {"_readme_low": "raw_content", "_code_low": "_code"}
_DERIVED = ("_packages", "_topics_low", "_code", "_name_low", "_desc_low", "_packages_low", "_joined", *_LATE)

_has = S.any_of


def in_topics(words) -> str:
    return f"exists(_topics_low, t -> {_has('t', words)})"


def in_packages(words) -> str:
    return f"exists(_packages, p -> {_has('p', words)})"


def in_code(words) -> str:
    joined = [w for w in words if re.search(_JOINT, w)]
    return f"((_joined AND {_has('_code', joined)}) OR {_has('_code', [w for w in words if w not in joined])})"


def in_names(words) -> str:
    return f"({_has('_name_low', words)} OR {_has('_desc_low', words)})"


def name_word(words) -> str:
    return f"coalesce({S.first_of('_name_low', words)}, {S.first_of('_desc_low', words)})"


def topic_with(words) -> str:
    return f"get(filter(_topics_low, t -> {_has('t', words)}), 0)"


MANY_LINKS_SQL = (f"(contains(raw_content, '{W.MANY_LINKS_TEXT}') AND "
                  f"regexp_count(raw_content, '{W.MANY_LINKS_TEXT.replace('.', '[.]')}') > {W.MANY_LINKS})")


_BIN, _MAIN = "'bin'", "'package main'"


def default_rules(words=W) -> list:
    """The ordered rule list over ``prepare``d rows, as SQL text."""
    code = in_code
    src = lambda rule, matched, conf: S.evidence("source_code", "repository_source", rule, matched, conf)
    topic = lambda rule, ws, conf: S.evidence("repository_topics", "github_topics", rule, topic_with(ws), conf)
    meta = lambda rule, ws, conf: S.evidence("repository_metadata", "github_repo", rule, name_word(ws), conf)
    manifest = lambda source, rule, matched, conf: S.evidence("package_manifest", source, rule, matched, conf)
    one = lambda item: f"array({item})"
    either = lambda cond, a, b: f"IF({cond}, array({a}), array({b}))"

    unclaimed = f"NOT {_has('_desc_low', words.SERVER_CLAIMS)}"
    data_library = (f"{unclaimed} AND ({_has('_desc_low', words.DATA_LIBRARY_PHRASES)} "
                    f"OR {_has('lower(name)', words.DATA_LIBRARY_NAMES)})")
    infra_topics = ", ".join(map(S.quote, words.DATA_INFRA_TOPICS))
    data_infra = (f"{unclaimed} AND ({_has('_desc_low', words.DATA_INFRA_PHRASES)} "
                  f"OR exists(_topics_low, t -> t IN ({infra_topics})))")

    impl, stdio, tools = code(words.SERVER_IMPL), code(words.STDIO_TRANSPORT), code(words.TOOL_DEFS)
    bin_mark, main_mark = in_packages(words.EXECUTABLE_MARKS), in_packages((words.EXECUTABLE_MAIN,))
    runtime = "identity_status = 'RUNTIME_VERIFIED'"
    votes = " + ".join(f"int({c})" for c in (impl, stdio, tools, f"({bin_mark} OR {main_mark})"))
    server_evidence = "concat(" + ", ".join((
        S.when(impl, src("mcp_server_impl", "'McpServer'", 0.9)),
        S.when(stdio, src("stdio_transport", "'StdioServerTransport'", 0.85)),
        S.when(tools, src("tool_definitions", "'tools.List'", 0.9)),
        f"CASE WHEN {bin_mark} THEN array({manifest('package.json', 'executable_entrypoint', _BIN, 0.8)}) "
        f"WHEN {main_mark} THEN array({S.evidence('source_code', 'go.mod/main.go', 'executable_entrypoint', _MAIN, 0.8)}) "
        f"ELSE {S.NO_EVIDENCE} END",
        S.when(runtime, S.evidence("runtime_handshake", "mcp_verification", "runtime_verified",
                                   "'MCPIdentityStatusRuntimeVerified'", 1.0)))) + ")"

    client = code(words.CLIENT_IMPL)
    sdk_pkg, library = in_packages(words.SDK_PACKAGES), (
        "(exists(_packages, p -> contains(p, 'modelcontextprotocol') AND NOT contains(p, 'sdk')) "
        "OR exists(_topics_low, t -> contains(t, 'mcp') AND NOT contains(t, 'sdk')))")
    coll_topics = f"filter(_topics_low, t -> {_has('t', words.COLLECTION_WORDS)})"
    coll_names = in_names(words.COLLECTION_WORDS)
    coll_evidence = "concat(" + ", ".join((
        S.when(coll_names, meta("collection_indicator", words.COLLECTION_WORDS, 0.85)),
        f"transform({coll_topics}, t -> {S.evidence('repository_topics', 'github_topics', 'collection_topic', 't', 0.8)})",
        S.when(MANY_LINKS_SQL, S.evidence("readme", "README", "many_repo_links", "'Multiple github.com links'", 0.7)))) + ")"
    agent_code = code(words.AGENT_IMPL)
    agent_tool = (f"exists(tools, t -> {_has('lower(t.description)', ('agent', 'autonomous', 'plan'))} "
                  "OR contains(lower(t.name), 'agent'))")
    agent_evidence = "concat(" + ", ".join((
        S.when(agent_code, src("agent_impl", S.first_of("_code", words.AGENT_IMPL), 0.85)),
        S.when(agent_tool, S.evidence("mcp_tool", "tools_list", "agent_tool", "'agent tool'", 0.8)),
        S.when("ai_level IN ('A4', 'A5')", S.evidence(
            "ai_relevance", "ai_scoring", "high_ai_relevance", "ai_level", 0.7)))) + ")"
    tool_code = code(words.TOOL_IMPL)
    pkg_word = lambda ws: S.first_of("array_join(_packages_low, '\\n')", ws)
    pkg_low = lambda ws: f"exists(_packages_low, p -> {_has('p', ws)})"
    fw_topic, kb_topic = in_topics(words.FRAMEWORK_WORDS), in_topics(words.KNOWLEDGE_WORDS)
    source_types = ", ".join(map(S.quote, words.DATASET_SOURCE_TYPES))
    typed_sources = f"filter(data_sources, d -> d.type IN ({source_types}))"
    api, plugin = _has("_code_low", words.API_WORDS), _has("_code_low", words.PLUGIN_WORDS)

    return [Rule(*r) for r in (
        ("data_library_guard", "AI_DATASET", "NONE", data_library, S.NO_EVIDENCE),
        ("data_infra_guard", "AI_INFRASTRUCTURE", "NONE", data_infra, S.NO_EVIDENCE),
        ("server", "MCP_SERVER", "SERVER", f"{runtime} OR {votes} >= 2", server_evidence),
        ("client", "MCP_CLIENT", "CLIENT", f"{client} AND NOT {code(words.CLIENT_BLOCKERS)}",
         S.when(client, src("mcp_client_impl", "'mcp.Client'", 0.9))),
        ("host", "MCP_HOST", "HOST", code(words.HOST_IMPL), one(src("mcp_host_impl", "'McpHost'", 0.9))),
        ("sdk", "MCP_SDK", "SDK", f"{sdk_pkg} OR {in_topics(words.SDK_TOPICS)}", either(
            sdk_pkg, manifest("package.json/go.mod", "mcp_sdk_dependency", "'@modelcontextprotocol/sdk'", 0.95),
            topic("mcp_sdk_topic", words.SDK_TOPICS, 0.8))),
        ("library", "MCP_LIBRARY", "LIBRARY", library,
         one(manifest("package_manifest", "mcp_library_dependency", "'modelcontextprotocol'", 0.8))),
        ("extension", "MCP_EXTENSION", "EXTENSION", code(words.EXTENSION_IMPL),
         one(src("mcp_extension_impl", "'McpExtension'", 0.9))),
        ("skill", "MCP_SKILL", "SKILL", code(words.SKILL_IMPL), one(src("mcp_skill_impl", "'McpSkill'", 0.9))),
        ("collection", "MCP_COLLECTION", "NONE",
         f"{coll_names} OR {in_topics(words.COLLECTION_WORDS)} OR {MANY_LINKS_SQL}", coll_evidence),
        ("agent", "AI_AGENT", "NONE", f"{agent_tool} OR {agent_code}", agent_evidence),
        ("tool", "AI_TOOL", "NONE", f"size(tools) BETWEEN 1 AND 5 OR {tool_code}", either(
            tool_code, src("tool_definition", "'ToolDefinition'", 0.85),
            S.evidence("mcp_tool", "tools_list", "few_tools", "'Tools list'", 0.75))),
        ("ai_sdk", "AI_SDK", "NONE", pkg_low(words.AI_SDK_PACKAGES),
         one(manifest("package_manifest", "ai_sdk_dependency", pkg_word(words.AI_SDK_PACKAGES), 0.9))),
        ("framework", "AI_FRAMEWORK", "NONE", f"{fw_topic} OR {pkg_low(words.FRAMEWORK_WORDS)}", either(
            fw_topic, topic("ai_framework_topic", words.FRAMEWORK_WORDS, 0.85),
            manifest("package_manifest", "ai_framework_dependency", pkg_word(words.FRAMEWORK_WORDS), 0.9))),
        ("ai_skill", "AI_SKILL", "NONE", f"{code((words.AI_SKILL_WORD,))} AND {code(words.AI_SKILL_FORMS)}",
         one(src("skill_definition", "'Skill'", 0.85))),
        ("knowledge", "AI_KNOWLEDGE_BASE", "NONE", f"{kb_topic} OR {_has('_desc_low', words.KNOWLEDGE_WORDS)}", either(
            kb_topic, topic("knowledge_base_topic", words.KNOWLEDGE_WORDS, 0.85),
            S.evidence("readme", "README", "knowledge_base_description",
                       S.first_of("_desc_low", words.KNOWLEDGE_WORDS), 0.75))),
        ("dataset", "AI_DATASET", "NONE", f"size({typed_sources}) > 0 OR {in_topics(words.DATASET_WORDS)}", either(
            f"size({typed_sources}) > 0", S.evidence(
                "data_source", "data_sources", "dataset_type", f"get({typed_sources}, 0).type", 0.9),
            topic("dataset_topic", words.DATASET_WORDS, 0.8))),
        ("api", "AI_API", "NONE", f"ai_score > 15 AND {api}",
         one(src("api_wrapper", S.first_of("_code_low", words.API_WORDS), 0.75))),
        ("application", "AI_APPLICATION", "NONE", f"{in_names(words.APPLICATION_WORDS)} AND ai_score > 10",
         one(meta("ai_app_indicator", words.APPLICATION_WORDS, 0.8))),
        ("infrastructure", "AI_INFRASTRUCTURE", "NONE", f"{in_topics(words.INFRA_WORDS)} AND ai_score > 10",
         one(topic("ai_infrastructure_topic", words.INFRA_WORDS, 0.85))),
        ("plugin", "AI_PLUGIN", "NONE", f"{plugin} AND contains(_code, 'AI')",
         one(src("ai_plugin", S.first_of("_code_low", words.PLUGIN_WORDS), 0.8))),
        ("tutorial", "AI_TUTORIAL", "NONE",
         f"{in_names(words.TUTORIAL_WORDS)} OR {_has('_readme_low', words.TUTORIAL_WORDS)}",
         one(S.evidence("readme", "README", "tutorial_indicator", f"coalesce({name_word(words.TUTORIAL_WORDS)}, "
                        f"{S.first_of('_readme_low', words.TUTORIAL_WORDS)})", 0.8))),
        ("example", "AI_EXAMPLE", "NONE", in_names(words.EXAMPLE_WORDS),
         one(meta("example_indicator", words.EXAMPLE_WORDS, 0.8))),
        ("ai_collection", "AI_COLLECTION", "NONE", f"{in_names(words.AI_COLLECTION_WORDS)} AND ai_score > 15",
         one(meta("ai_collection_indicator", words.AI_COLLECTION_WORDS, 0.85))),
        ("registry", "AI_REGISTRY", "NONE", in_names(words.REGISTRY_WORDS),
         one(meta("registry_indicator", words.REGISTRY_WORDS, 0.85))),
        ("ai_related", "AI_RELATED_PROJECT", "NONE", "ai_score > 5",
         one(S.evidence("ai_relevance", "ai_scoring", "ai_relevant", "ai_level", 0.7))),
        ("non_ai", "NON_AI_PROJECT", "NONE", "ai_score = 0 AND region_score = 0",
         one(S.evidence("ai_relevance", "ai_scoring", "no_ai_signals", "'AI relevance = 0'", 1.0))),
    )]


# rules whose evidence items carry their own conditions
_SELF_GATED = ("server", "client", "agent")


def classify(df: DataFrame, out="classification", rules=None, leaky_evidence=False) -> DataFrame:
    """Adds struct<primary, role, rule, confidence, evidence>.

    Evidence is the winner's own.  ``leaky_evidence=True`` also keeps what the
    rules before the winner had collected, which shifts the confidence.
    """
    rules = rules or default_rules()
    label = lambda field, default: S.ladder(
        [(f"_winner = {i}", S.quote(getattr(r, field))) for i, r in enumerate(rules)], S.quote(default))
    if leaky_evidence:
        gate = lambda r: "true" if r.name in _SELF_GATED else f"({r.condition})"
        evidence = "concat(" + ", ".join(
            f"IF(_winner >= {i} AND {gate(r)}, {r.evidence}, {S.NO_EVIDENCE})" for i, r in enumerate(rules)) + ")"
    else:
        evidence = S.ladder([(f"_winner = {i}", r.evidence) for i, r in enumerate(rules)], S.NO_EVIDENCE)
    conditions = [(r.condition, str(i)) for i, r in enumerate(rules)]
    late = next((i for i, r in enumerate(rules) if any(c in r.condition or c in r.evidence for c in _LATE)), len(rules))
    tried = lambda part, otherwise: F.expr(S.ladder(part, str(otherwise)) if part else str(otherwise))
    return (prepare(df)
            .withColumn("_early", tried(conditions[:late], late))
            .withColumns({c: F.when(F.col("_early") == late, F.lower(text)) for c, text in _LATE.items()})
            .withColumn("_winner", F.when(F.col("_early") < late, F.col("_early")).otherwise(tried(conditions[late:], len(rules))))
            .withColumn("_evidence", F.expr(evidence))
            .transform(computed_once, out, F.struct(
                F.expr(label("label", "UNKNOWN")).alias("primary"), F.expr(label("role", "NONE")).alias("role"),
                F.expr(label("name", "default")).alias("rule"),
                E.mean_confidence(F.col("_evidence")).alias("confidence"),
                F.col("_evidence").alias("evidence")))
            .drop("_early", "_winner", "_evidence", *_DERIVED))


def classify_by_words(text: Column, ordered, default) -> Column:
    """Ordered (label, words) table -> first label whose words occur."""
    return first_true([(regex.contains_any(text, ws), F.lit(label)) for label, ws in ordered], default)


def heuristic_class(name: Column, description: Column, name_rules=W.NAME_RULES,
                    text_rules=W.TEXT_RULES, default=W.SEED_DEFAULT) -> Column:
    """Class for rows without a category: name words, then text words."""
    low = F.lower(name)
    text = F.concat_ws(" ", low, F.lower(description))
    return F.coalesce(classify_by_words(low, name_rules, F.lit(None)),
                      classify_by_words(text, text_rules, F.lit(None)), F.lit(default))


def seed_class(categories: Column, name: Column, description: Column) -> Column:
    """Legacy category code when there is one, else the heuristic."""
    table = F.create_map(*[F.lit(x) for kv in vocab.SEED_CATEGORY_CLASS.items() for x in kv])
    by_code = F.coalesce(F.try_element_at(table, F.get(categories, F.lit(0))), F.lit(W.SEED_DEFAULT))
    return F.when(F.size(categories) > 0, by_code).otherwise(heuristic_class(name, description))


def needs_review(confidence: Column, region_score: Column, ai_score: Column,
                 floor=0.7, low=20, high=55) -> Column:
    """Low rule confidence, or both scores in the ambiguous band."""
    return (confidence < floor) | (region_score.between(low, high) & ai_score.between(low, high))


def needs_review_legacy(score: Column, low=20, high=55) -> Column:
    return score.between(low, high)


def is_protocol_class(primary: Column) -> Column:
    return primary.isin(*vocab.MCP_CLASSES)


def is_ai_class(primary: Column) -> Column:
    return primary.isin(*vocab.AI_CLASSES)
