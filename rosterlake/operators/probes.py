"""Verdicts over a landed log of protocol probes.

Input: one row per response, ``(key, method, http_status, body, latency_ms)``.
"""

from pyspark.sql import Column, DataFrame, functions as F

RESPONSE = """struct<
  id:bigint,
  error:struct<code:bigint,message:string>,
  result:struct<
    protocolVersion:string, capabilities:map<string,string>,
    serverInfo:struct<name:string,version:string>,
    tools:array<struct<name:string,description:string,inputSchema:string>>,
    resources:array<struct<uri:string,name:string,description:string,mimeType:string>>,
    prompts:array<struct<name:string,description:string>>>>"""
REQUEST_ID = {"initialize": 1, "tools/list": 2, "resources/list": 3, "prompts/list": 4}


def event_payload(body: Column, request_id: Column) -> Column:
    """JSON of the first ``data:`` line whose id is the request's; the body
    itself when it is not an event stream."""
    payloads = F.transform(
        F.filter(F.split(body, "\r?\n"), lambda l: F.startswith(l, F.lit("data:"))),
        lambda l: F.trim(F.substr(l, F.lit(6))))
    same_id = F.filter(payloads, lambda p: F.get_json_object(p, "$.id") == request_id.cast("string"))
    streamed = F.contains(body, F.lit("data:")) & ~F.startswith(F.trim(body), F.lit("{"))
    return F.when(streamed, F.get(same_id, F.lit(0))).otherwise(body)


def parse(log: DataFrame) -> DataFrame:
    ids = F.create_map(*[F.lit(x) for kv in REQUEST_ID.items() for x in kv])
    payload = event_payload(F.col("body"), F.try_element_at(ids, F.col("method")))
    return log.withColumn("r", F.from_json(payload, RESPONSE))


def tool_summary(names: Column, shown=5) -> Column:
    """Display text: the first ``shown`` names and how many more there are."""
    head = F.array_join(F.slice(names, 1, shown), ", ")
    return F.when(F.size(names) > shown, F.concat(
        head, F.lit(" (+ "), F.size(names) - shown, F.lit(" more)"))).otherwise(head)


def verdicts(log: DataFrame, key="id", shown=5) -> DataFrame:
    """PASSED / FAILED / ERROR per key with the listed tools, resources and prompts.

    The lists are whole, without their empty rows; of several answers to one request the longest list counts.
    ``tool_summary`` shows the first ``shown`` names for display.

    The verdict follows initialize, then tools/list: a request that never got
    an answer is an ERROR, a bad status, body or protocol error a FAILED.
    """
    p = parse(log)
    r, m = F.col("r"), F.col("method")
    good = (F.col("http_status") == 200) & r.isNotNull() & r["error"].isNull() & r["result"].isNotNull()
    tools = F.filter(r["result"]["tools"], lambda t: F.coalesce(
        t["name"], t["description"], t["inputSchema"], F.lit("")) != "")
    resources = F.filter(r["result"]["resources"], lambda x: F.coalesce(x["uri"], F.lit("")) != "")
    prompts = F.filter(r["result"]["prompts"], lambda x: F.coalesce(x["name"], F.lit("")) != "")
    caps = F.map_keys(r["result"]["capabilities"])
    of = lambda method, value: F.max(F.when(m == method, value))
    state = F.when(good, 2).when(F.col("http_status").isNull(), 0).otherwise(1)
    listed = (m == "tools/list") & good
    longest = lambda asked, items: F.max(F.when(asked, F.struct(F.size(items).alias("n"), items.alias("items"))))
    out = p.groupBy(key).agg(
        of("initialize", state).alias("_init"), of("tools/list", state).alias("_tools"),
        of("initialize", r["result"]["protocolVersion"]).alias("protocol_version"),
        F.bool_or((m == "initialize") & good & F.array_contains(caps, "tools")).alias("_cap_tools"),
        F.bool_or((m == "initialize") & good & F.array_contains(caps, "resources")).alias("_cap_res"),
        F.bool_or((m == "initialize") & good & F.array_contains(caps, "prompts")).alias("_cap_pr"),
        longest(listed, tools).alias("_tool_list"),
        longest((m == "resources/list") & good, resources).alias("_resource_list"),
        longest((m == "prompts/list") & good, prompts).alias("_prompt_list"),
        F.max("latency_ms").alias("max_latency_ms"))
    out = out.select("*", *[F.col(f"_{kind}_list.n").alias(f"{kind}_count") for kind in ("tool", "resource", "prompt")],
                     *[F.col(f"_{kind}_list.items").alias(f"{kind}s") for kind in ("tool", "resource", "prompt")])
    worst = F.least(F.coalesce("_init", F.lit(0)), F.coalesce("_tools", F.lit(0)))
    init = F.coalesce("_init", F.lit(0))
    decided = F.when(init < 2, init).otherwise(worst)
    flag = lambda cap, count: F.coalesce(F.col(cap), F.lit(False)) | F.col(count).isNotNull()
    return out.select(
        key, F.element_at(F.array(F.lit("ERROR"), F.lit("FAILED"), F.lit("PASSED")), decided + 1).alias("status"),
        "protocol_version", flag("_cap_tools", "tool_count").alias("tools_listable"),
        flag("_cap_res", "resource_count").alias("resources_listable"),
        flag("_cap_pr", "prompt_count").alias("prompts_listable"),
        F.coalesce("tool_count", F.lit(0)).alias("tool_count"),
        tool_summary(F.transform("tools", lambda t: t["name"]), shown).alias("tool_summary"),
        F.coalesce("resource_count", F.lit(0)).alias("resource_count"),
        F.coalesce("prompt_count", F.lit(0)).alias("prompt_count"), "max_latency_ms", "tools", "resources", "prompts")
