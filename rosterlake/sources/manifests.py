"""Package manifests as a table job over ``(key, filename, content)``."""

from pyspark.sql import Column, DataFrame, functions as F

# fixed value: which file decides when an entity has several
FILE_PRIORITY = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml",
                 "server.json", "mcp.json", "manifest.json")
_JSON_TYPES = ("package.json", "server.json", "mcp.json", "manifest.json", "json")
_SERVER = "struct<command:string,transport:string,type:string,args:array<string>,env:map<string,string>>"
_JSON = f"""struct<mcpServers:map<string,{_SERVER}>, mcp:struct<servers:map<string,{_SERVER}>>,
  name:string, transport:string, command:string,
  tools:array<struct<name:string,description:string,inputSchema:string>>>"""


def file_type(filename: Column) -> Column:
    """Manifest type by file-name suffix; anything else is read as JSON."""
    expr = None
    for name in ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "server.json", "mcp.json",
                 "manifest.json"):
        cond = F.endswith(filename, F.lit(name))
        expr = F.when(cond, name.lower()) if expr is None else expr.when(cond, name.lower())
    return expr.otherwise("json")


def _last(servers: Column):
    """(name, server) with the greatest name: a fixed choice where maps have no order."""
    name = F.array_max(F.map_keys(servers))
    return name, F.try_element_at(servers, name)


def parse_json(content: Column) -> Column:
    """struct<server_name, transport, command, args, env, tools> or NULL.

    A top-level ``mcpServers`` map decides alone; otherwise ``mcp.servers`` and
    then the top-level fields fill in.
    """
    doc = F.from_json(content, _JSON, {"mode": "PERMISSIVE"})
    readable = F.get_json_object(content, "$").isNotNull() & F.startswith(F.trim(content), F.lit("{"))
    main, nested = doc["mcpServers"], doc["mcp"]["servers"]
    (main_name, m), (nested_name, n) = _last(main), _last(nested)
    has_main = doc["mcpServers"].isNotNull()
    text = lambda c: F.coalesce(c, F.lit(""))
    name = F.when(has_main, text(main_name)).otherwise(
        F.coalesce(F.nullif(nested_name, F.lit("")), doc["name"], F.lit("")))
    transport = F.when(has_main, text(m["transport"])).otherwise(
        F.coalesce(doc["transport"], n["type"], n["transport"], F.lit("")))
    command = F.when(has_main, text(m["command"])).otherwise(
        F.coalesce(doc["command"], n["command"], F.lit("")))
    args = F.when(has_main, F.flatten(F.transform(
        F.array_sort(F.map_keys(main)),
        lambda k: F.coalesce(F.element_at(main, k)["args"], F.array().cast("array<string>")))))
    no_env = F.create_map().cast("map<string,string>")
    env_of = lambda k: F.coalesce(F.element_at(main, k)["env"], no_env)
    # variables of all servers; the later name wins where two set the same one
    env = F.when(has_main, F.aggregate(F.array_sort(F.map_keys(main)), no_env, lambda acc, k: F.map_concat(
        F.map_filter(acc, lambda name, _: ~F.map_contains_key(env_of(k), name)), env_of(k))))
    return F.when(readable, F.struct(
        name.alias("server_name"), transport.alias("transport"), command.alias("command"),
        F.coalesce(args, F.array().cast("array<string>")).alias("args"),
        F.coalesce(env, F.create_map().cast("map<string,string>")).alias("env"),
        F.coalesce(doc["tools"], F.array().cast(
            "array<struct<name:string,description:string,inputSchema:string>>")).alias("tools")))


def _section_lines(content: Column, header: str) -> Column:
    """Trimmed lines between a section header and the next ``[``."""
    lines = F.transform(F.split(content, "\n"), lambda l: F.trim(l))
    start = F.aggregate(
        lines, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")),
        lambda acc, l: F.struct(
            (acc["i"] + 1).alias("i"),
            F.when((acc["at"] == 0) & F.startswith(l, F.lit(header)), acc["i"] + 1)
             .otherwise(acc["at"]).alias("at")))["at"]
    after = F.when(start > 0, F.slice(lines, start + 1, F.size(lines)))
    stop = F.array_position(F.transform(after, lambda l: F.startswith(l, F.lit("["))
                                        & ~F.startswith(l, F.lit(header))), F.lit(True)).cast("int")
    body = F.when(stop > 0, F.slice(after, 1, stop - 1)).otherwise(after)
    return F.filter(body, lambda l: ~F.startswith(l, F.lit(header)))


def _value(lines: Column, field: str) -> Column:
    """Value of the last line that starts with ``field``."""
    hits = F.filter(lines, lambda l: F.startswith(l, F.lit(field)))
    raw = F.regexp_extract(F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit("")), r"(?s)^[^=]*=(.*)\z", 1)
    return F.trim(F.trim(raw), F.lit('"'))


def _info(name, transport, command) -> Column:
    return F.struct(
        name.alias("server_name"), transport.alias("transport"), command.alias("command"),
        F.array().cast("array<string>").alias("args"), F.create_map().cast("map<string,string>").alias("env"),
        F.array().cast("array<struct<name:string,description:string,inputSchema:string>>").alias("tools"))


def parse_pyproject(content: Column) -> Column:
    entry = _section_lines(content, '[project.entry-points."mcp"]')
    tool = _section_lines(content, "[tool.mcp]")
    lines = F.when(F.size(entry) > 0, entry).otherwise(tool)
    return _info(F.lit(""), _value(lines, "transport"), _value(lines, "command"))


def parse_go_mod(content: Column) -> Column:
    names = F.regexp_extract_all(content, F.lit(r"(?md)^[ \t\r]*module[ ]+([^\s]+)"), F.lit(1))
    return _info(F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("")), F.lit("stdio"), F.lit(""))


def parse_cargo(content: Column) -> Column:
    meta = _section_lines(content, "[package.metadata.mcp]")
    return _info(_value(_section_lines(content, "[package]"), "name"),
                 _value(meta, "transport"), _value(meta, "command"))


def parse(files: DataFrame) -> DataFrame:
    """Adds ``file_type`` and ``manifest`` (NULL when the file is unreadable)."""
    kind = file_type(F.col("filename"))
    text = F.col("content")
    return (files.withColumn("file_type", kind)
            .withColumn("manifest", F.when(F.col("file_type") == "pyproject.toml", parse_pyproject(text))
                        .when(F.col("file_type") == "go.mod", parse_go_mod(text))
                        .when(F.col("file_type") == "cargo.toml", parse_cargo(text))
                        .otherwise(parse_json(text))))


def first_manifest(parsed: DataFrame, key="id") -> DataFrame:
    """The manifest of the highest-priority readable file per entity."""
    prio = F.create_map(*[F.lit(x) for i, n in enumerate(FILE_PRIORITY) for x in (n, i)])
    ranked = parsed.withColumn("_p", F.try_element_at(prio, F.col("filename"))).filter(F.col("_p").isNotNull())
    # unreadable files drop out by their NULL rank, so parsing is not repeated in a filter
    best = F.min_by(F.struct("filename", "manifest"), F.when(F.col("manifest").isNotNull(), F.col("_p")))
    return ranked.groupBy(key).agg(best.alias("m")).filter(F.col("m").isNotNull()).select(key, "m.filename", "m.manifest")
