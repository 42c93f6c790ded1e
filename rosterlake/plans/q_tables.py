"""Table maintenance over the event log and the order tables."""

from pyspark.sql import functions as F

from ..operators import resolve
from ..session import expire, fresh_path
from ..sinks import tables as K
from ..sources import landed
from . import bindings as B
from .book import query

_TS = "'%Y-%m-%d %H:%M:%S'"


def _log(spark, d):
    """Events as a change log of entities: user = entity, day = run."""
    return B.table(spark, d, "events").select(
        F.col("user_id").alias("id"), "event_id", F.date_format("ts", "yyyyMMdd").alias("crawl_id"),
        F.col("event_type").alias("status"), F.get_json_object("props", "$.k").cast("int").alias("score"),
        F.col("ts").alias("last_seen"), F.col("ts").alias("first_seen"))


LOG = "log AS (SELECT user_id AS id, event_id, strftime(ts, '%Y%m%d') AS crawl_id, event_type AS status, CAST(json_extract_string(props, '$.k') AS INTEGER) AS score, ts FROM events)"
_FINAL = f"SELECT id, arg_max(status, event_id) AS status, arg_max(score, event_id) AS score, strftime(arg_min(ts, event_id), {_TS}) AS first_seen, strftime(arg_max(ts, event_id), {_TS}) AS last_seen FROM log GROUP BY id"
_stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("final_state", f"WITH {LOG} {_FINAL}")
def final_state(spark, d):
    """The whole log folded in one aggregation."""
    out = K.upsert_log(_log(spark, d).drop("crawl_id"), "id", [F.col("event_id")], ("first_seen",))
    return out.select("id", "status", "score", _stamp("first_seen"), _stamp("last_seen"))


@query("final_state_by_batches", f"WITH {LOG} {_FINAL}")
def final_state_by_batches(spark, d):
    """The same state reached by three successive upserts."""
    log = _log(spark, d).drop("crawl_id")
    lo, hi = log.agg(F.min("event_id"), F.max("event_id")).first()
    a, b = (lo or 0) + ((hi or 0) - (lo or 0)) // 3, (lo or 0) + 2 * ((hi or 0) - (lo or 0)) // 3
    at = F.col("event_id")
    # complements, so that no event can fall between two batches
    batches = [log.filter(at <= a), log.filter((at > a) & (at <= b)), log.filter(~F.coalesce(at <= b, F.lit(False)))]
    order = [at]
    state = K.upsert_log(batches[0], "id", order, ("first_seen",)).select(*log.columns)
    for batch in batches[1:]:
        # within a batch the earliest first_seen counts, as it would row by row
        fresh = K.upsert_log(batch, "id", order, ("first_seen",)).select(*log.columns)
        state = K.upsert(state, fresh, "id", keep=("first_seen",))
    return state.select("id", "status", "score", _stamp("first_seen"), _stamp("last_seen"))


@query("child_upserts", """SELECT l_orderkey, l_linenumber, arg_max(l_quantity, struct_pack(d := l_shipdate, p := l_partkey, s := l_suppkey, q := l_quantity)) AS l_quantity
FROM lineitem GROUP BY ALL""")
def child_upserts(spark, d):
    """Child rows under a composite key: earlier shipments stored, later ones upserted; the last one wins."""
    rows = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_partkey", "l_suppkey")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]
    keys, day = ["l_orderkey", "l_linenumber"], F.unix_date(F.to_date("l_shipdate"))
    lo, hi = rows.agg(F.min(day), F.max(day)).first()
    late = F.coalesce(day > ((lo or 0) + (hi or 0)) // 2, F.lit(True))
    stored = K.upsert_log(rows.filter(~late), keys, order, ()).select(*rows.columns)
    return K.upsert(stored, rows.filter(late), keys, keep=(), order=order).select("l_orderkey", "l_linenumber", "l_quantity")


@query("inserted_links", """SELECT DISTINCT o_custkey AS id, o_orderpriority AS source_id FROM orders""")
def inserted_links(spark, d):
    """Insert-or-ignore of the links of open orders into those of finished ones."""
    links = B.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("source_id"), "o_orderstatus")
    first = links.filter(F.col("o_orderstatus") == "F").select("id", "source_id").distinct()
    second = links.filter(F.col("o_orderstatus") != "F").select("id", "source_id")
    return K.insert_new(first, second, ["id", "source_id"])


@query("remaining_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def remaining_customers(spark, d):
    gone = B.table(spark, d, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return K.delete(B.table(spark, d, "customer").select("c_custkey"), gone, "c_custkey")


@query("snapshot_history", f"""WITH {LOG} SELECT id, event_id, row_number() OVER w AS sequence, strftime(lag(ts) OVER w, {_TS}) AS previous FROM log WINDOW w AS (PARTITION BY id ORDER BY ts, event_id)""")
def snapshot_history(spark, d):
    out = K.history(_log(spark, d), "id", ("last_seen", "event_id"))
    return out.select("id", "event_id", "sequence", _stamp("previous_last_seen")).withColumnRenamed("previous_last_seen", "previous")


@query("snapshot_changes", f"""WITH {LOG}, p AS (SELECT *, lag(status) OVER w AS before, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY id ORDER BY ts, event_id))
SELECT id, event_id, status FROM p WHERE n = 1 OR before <> status""")
def snapshot_changes(spark, d):
    return K.snapshot_changes(_log(spark, d), "id", ("last_seen", "event_id"), ["status"]).select("id", "event_id", "status")


@query("latest_source_rows", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_source_rows(spark, d):
    rows = B.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return resolve.latest_per_key(rows, ["user_id", "event_type"], [F.col("event_id")], ["event_id", "value"])


@query("run_log", f"""WITH {LOG} SELECT crawl_id, strftime(min(ts), {_TS}) AS started_at, strftime(max(ts), {_TS}) AS finished_at, count(*) AS candidates_found, count(*) FILTER (status = 'error') AS failed FROM log GROUP BY 1""")
def run_log(spark, d):
    """Run rows: counters replaced, start kept, newest first."""
    log = _log(spark, d)
    parts = [log.filter((F.hour("last_seen") < 12) == h).groupBy("crawl_id").agg(
        F.min("last_seen").alias("started_at"), F.max("last_seen").alias("finished_at"),
        F.count("*").alias("candidates_found"), F.count_if(F.col("status") == "error").alias("failed")) for h in (True, False)]
    both = parts[0].unionByName(parts[1]).groupBy("crawl_id").agg(
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
        F.sum("candidates_found").alias("candidates_found"), F.sum("failed").alias("failed"))
    runs = K.upsert(parts[0], both, "crawl_id", keep=())
    return K.run_history(runs).select("crawl_id", _stamp("started_at"), _stamp("finished_at"), "candidates_found", "failed")


@query("run_folders", f"WITH {LOG} SELECT crawl_id, count(*) AS rows, count(DISTINCT id) AS ids FROM log GROUP BY crawl_id")
def run_folders(spark, d):
    """Runs appended one after the other to a history with a folder each."""
    log, path = _log(spark, d).select("id", "event_id", "crawl_id"), fresh_path(spark, "history")
    for half in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 != 0):
        K.append_history(log.filter(half), path)
    expire(spark, path)
    # a folder's name would otherwise be read as a number
    kept = spark.read.schema("id long, event_id long, crawl_id string").parquet(path)
    return kept.groupBy("crawl_id").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))


@query("backed_up_orders", "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def backed_up_orders(spark, d):
    """A copy is made once; a second backup of changed rows leaves it as it is."""
    orders, path = B.table(spark, d, "orders").select("o_orderstatus", "o_totalprice"), fresh_path(spark, "backup")
    first = K.backup_once(spark, orders, path)
    second = K.backup_once(spark, orders.withColumn("o_totalprice", F.lit(0.0)), path)
    if (first, second) != (True, False):
        raise RuntimeError("the backup was not made exactly once")
    expire(spark, path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("migration_log", f"""WITH {B.ENTS} SELECT id AS old_id, CASE WHEN doc_id % 6 > 0 THEN {B.CID_SQL} END AS new_id,
  CASE WHEN doc_id % 6 > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, CASE WHEN doc_id % 6 = 0 THEN 'bad row ' || id END AS error_message FROM ents""")
def migration_log(spark, d):
    from ..functions import urls
    rows = B.doc_entities(spark, d)
    return K.migration_log(rows, F.col("doc_id") % 6 > 0, F.concat(F.lit("bad row "), "id"),
                           new_id=F.sha2(urls.identity_url(F.col("repo_url")), 256))


@query("linked_sources", """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def linked_sources(spark, d):
    """Entity -> link -> source as two equi joins."""
    customers = B.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    links = B.table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return landed.link_sources(customers, links, B.table(spark, d, "region"), "n_nationkey", "r_regionkey") \
                 .select("c_custkey", "n_name", "r_name")


@query("looked_up_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def looked_up_rows(spark, d):
    return landed.by_id(B.table(spark, d, "orders"), 77, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("table_ids", "SELECT count(*) AS rows, sum(s_suppkey)::BIGINT AS key_sum FROM supplier")
def table_ids(spark, d):
    keys = landed.ids(B.table(spark, d, "supplier"), "s_suppkey")
    return keys.agg(F.count("*").alias("rows"), F.sum("s_suppkey").alias("key_sum"))
