"""State machines, promotion, incremental selection, validation."""

from pyspark.sql import functions as F

from ..operators import lifecycle as L, ranking
from ..rules import vocab
from . import bindings as B
from .book import query
from .q_views import ROWS, registry_rows

_MACHINES = {"entity": (vocab.ENTITY_STATUSES, vocab.ENTITY_MOVES), "identity": (vocab.IDENTITY_STATUSES, vocab.IDENTITY_MOVES),
             "security": (vocab.SECURITY_STATUSES, vocab.SECURITY_MOVES)}


def _steps(spark, d, states):
    """Moves of a user's state over time: one step per event after the first."""
    rows = B.table(spark, d, "events").select(
        "user_id", "event_id", B._pick(states, F.col("event_id") * 7 + F.col("user_id")).alias("state"))
    return ranking.with_previous(rows, "user_id", ("event_id",), ["state"]) \
        .filter(F.col("position") > 1).withColumnRenamed("previous_state", "before")


def _moves_sql(name):
    states, moves = _MACHINES[name]
    ok = " OR ".join(f"(before = '{b}' AND state IN ({', '.join(map(B.quote, a))}))" for b, a in moves.items())
    return f"""SELECT '{name}' AS machine, before, state AS after, count(*) AS moves, bool_and({ok}) AS allowed FROM
 (SELECT {B.sql_pick(states, 'event_id * 7 + user_id')} AS state, lag({B.sql_pick(states, 'event_id * 7 + user_id')}) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
 WHERE before IS NOT NULL GROUP BY before, state"""


@query("state_moves", " UNION ALL ".join(_moves_sql(n) for n in _MACHINES))
def state_moves(spark, d):
    parts = []
    for name, (states, moves) in _MACHINES.items():
        checked = L.check_moves(_steps(spark, d, states), "before", "state", moves)
        parts.append(checked.groupBy("before", F.col("state").alias("after")).agg(
            F.count("*").alias("moves"), F.bool_and("allowed").alias("allowed")).withColumn("machine", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("rejected_moves", f"SELECT before, after, moves AS rows FROM ({_moves_sql('entity')}) WHERE NOT allowed")
def rejected_moves(spark, d):
    steps = _steps(spark, d, vocab.ENTITY_STATUSES).withColumnRenamed("state", "after")
    return L.rejected_moves(steps, "before", "after", vocab.ENTITY_MOVES)


_RUN = ("PASSED", "FAILED", "ERROR", None)


@query("promotion", f"""WITH {ROWS}, p AS (SELECT *, doc_id % 3 > 0 AS chk, {B.sql_pick(_RUN, 'doc_id')} AS run FROM registry),
g AS (SELECT *, chk AND coalesce(run = 'PASSED', FALSE) AND security_status <> 'BLOCKED' AND identity_status IN ('STATIC_VERIFIED', 'RUNTIME_VERIFIED', 'VERIFIED') AS gate,
  CASE WHEN identity_status = 'CANDIDATE' AND chk THEN 'STATIC_VERIFIED' WHEN identity_status = 'STATIC_VERIFIED' AND run = 'PASSED' THEN 'RUNTIME_VERIFIED'
    WHEN identity_status = 'RUNTIME_VERIFIED' AND chk AND run = 'PASSED' AND security_status <> 'BLOCKED' THEN 'VERIFIED' ELSE identity_status END AS step FROM p)
SELECT id, step, gate, CASE WHEN gate THEN step ELSE identity_status END AS status FROM g""")
def promotion(spark, d):
    s, chk, run, sec = F.col("identity_status"), F.col("doc_id") % 3 > 0, B._pick(_RUN, F.col("doc_id")), F.col("security_status")
    return registry_rows(spark, d).select(
        "id", L.promote(s, chk, run, sec).alias("step"), L.promotion_gate(s, chk, run, sec).alias("gate"),
        L.promote_gated(s, chk, run, sec).alias("status"))


@query("changed_entities", f"""WITH {B.ENTS} SELECT id, coalesce(CASE WHEN doc_id % 8 > 0 THEN pushed_at END > last_seen, TRUE) AS changed FROM ents""")
def changed_entities(spark, d):
    return B.doc_entities(spark, d).select("id", L.changed_since(
        F.when(F.col("doc_id") % 8 > 0, F.col("pushed_at")), F.col("last_seen")).alias("changed"))


_SOURCES = ("github", "registry", "full", "other")


@query("due_sources", f"""WITH r AS (SELECT user_id, max(ts) AS last_run FROM events GROUP BY 1)
SELECT user_id, TIMESTAMP '2024-01-31 12:00:00' - last_run >= to_hours(CASE WHEN user_id % 4 = 2 THEN 168 ELSE 24 END) AS due FROM r""")
def due_sources(spark, d):
    runs = B.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_run"))
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return runs.select("user_id", L.due(B._pick(_SOURCES, F.col("user_id")), F.col("last_run"), now).alias("due"))


@query("unprocessed_orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unprocessed_orders(spark, d):
    done = B.table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.unprocessed(B.table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


_EP = "list_filter(endpoints, lambda e: e.type = 'MCP_RUNTIME_ENDPOINT')[1].url"


@query("verification_eligibility", f"""WITH {ROWS}, e AS (SELECT id, identity_status, {_EP} AS url FROM registry),
r AS (SELECT *, CASE WHEN identity_status <> 'STATIC_VERIFIED' THEN 'static_verified_required' WHEN url IS NULL THEN 'runtime_endpoint_required' ELSE 'eligible' END AS reason FROM e)
SELECT id, reason = 'eligible' AS eligible, reason, CASE WHEN reason = 'eligible' THEN url END AS url, CASE WHEN reason = 'eligible' THEN
  CASE WHEN contains(lower(url), 'stdio') THEN 'stdio' WHEN contains(lower(url), 'sse') THEN 'sse' ELSE 'streamable-http' END END AS transport FROM r""")
def verification_eligibility(spark, d):
    return registry_rows(spark, d).select(
        "id", L.eligibility(F.col("identity_status"), F.col("endpoints")).alias("e")).select("id", "e.*")


@query("violations", f"""WITH {ROWS}, b AS (SELECT *, CASE WHEN doc_id % 40 = 0 THEN 'T9' ELSE region_level END AS lvl, CASE WHEN doc_id % 30 = 0 THEN 150 ELSE quality_score END AS qs,
  CASE WHEN doc_id % 20 = 0 THEN ' ' ELSE name END AS nm FROM registry)
SELECT id, 'region_level' AS "column", 'enum' AS problem, lvl AS value FROM b WHERE lvl = 'T9'
UNION ALL SELECT id, 'quality_grade', 'enum', quality_grade FROM b WHERE quality_grade = ''
UNION ALL SELECT id, 'quality_score', 'range', CAST(qs AS VARCHAR) FROM b WHERE qs > 100
UNION ALL SELECT id, 'name', 'required', nm FROM b WHERE trim(nm) = ''""")
def violations(spark, d):
    n = F.col("doc_id")
    rows = registry_rows(spark, d).withColumns({
        "region_level": F.when(n % 40 == 0, "T9").otherwise(F.col("region_level")),
        "quality_score": F.when(n % 30 == 0, 150).otherwise(F.col("quality_score")),
        "name": F.when(n % 20 == 0, " ").otherwise(F.col("name"))})
    return L.violations(rows)
