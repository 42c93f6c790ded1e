"""Streaming forms and request windows over ``events``."""

from pyspark.sql import functions as F

from ..operators import rates
from ..session import expire, fresh_path
from ..sinks import tables
from ..streaming import jobs
from . import bindings as B
from .book import query

_TS = "'%Y-%m-%d %H:%M:%S.%f'"
_OUT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_DAY = 86400


def _stream(spark, d):
    """The events file as a stream source."""
    schema = B.table(spark, d, "events").schema
    stream = jobs.file_stream(spark, d, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _windows_sql(n, key="user_id"):
    return f"""WITH RECURSIVE ev AS (SELECT {key} AS k, ts, event_id FROM events),
opens AS (SELECT k, min(ts) AS opened FROM ev GROUP BY k
  UNION ALL SELECT o.k, (SELECT min(ts) FROM ev e WHERE e.k = o.k AND e.ts > o.opened + INTERVAL 1 DAY) FROM opens o
    WHERE EXISTS (SELECT 1 FROM ev e WHERE e.k = o.k AND e.ts > o.opened + INTERVAL 1 DAY)),
w AS (SELECT o.k, o.opened, e.ts, e.event_id, row_number() OVER (PARTITION BY o.k, o.opened ORDER BY e.ts, e.event_id) AS place
  FROM opens o JOIN ev e ON e.k = o.k AND e.ts >= o.opened AND e.ts <= o.opened + INTERVAL 1 DAY)"""


@query("request_windows", f"""{_windows_sql(2)} SELECT k AS user_id, strftime(opened, {_TS}) AS opened_at, count(*) AS requests,
  least(count(*), 2) AS allowed, greatest(count(*) - 2, 0) AS throttled FROM w GROUP BY k, opened""")
def request_windows(spark, d):
    """Day-long windows opened by a user's first request, two requests allowed."""
    out = rates.key_opened_windows(B.table(spark, d, "events"), "user_id", "ts", 2, _DAY)
    return out.withColumn("opened_at", F.date_format("opened_at", _OUT))


@query("request_windows_one_key", f"""{_windows_sql(50, "'all'")} SELECT k AS key, strftime(opened, {_TS}) AS opened_at, count(*) AS requests,
  least(count(*), 50) AS allowed, greatest(count(*) - 50, 0) AS throttled FROM w GROUP BY k, opened""")
def request_windows_one_key(spark, d):
    """Every request under one key: the hot-key case."""
    log = B.table(spark, d, "events").withColumn("key", F.lit("all"))
    out = rates.key_opened_windows(log, "key", "ts", 50, _DAY)
    return out.withColumn("opened_at", F.date_format("opened_at", _OUT))


@query("request_verdicts", f"{_windows_sql(2)} SELECT k AS user_id, event_id, place, place <= 2 AS allowed FROM w")
def request_verdicts(spark, d):
    out = rates.request_verdicts(B.table(spark, d, "events"), "user_id", "ts", "event_id", 2, _DAY)
    return out.select("user_id", "event_id", "place", "allowed")


@query("request_stream", f"{_windows_sql(2)} SELECT k AS user_id, event_id, place <= 2 AS allowed FROM w")
def request_stream(spark, d):
    """The same verdicts from the stateful stream."""
    stream = jobs.rate_stream(_stream(spark, d), "user_id", "ts", "event_id", 2, _DAY)
    return jobs.run_available(stream, fresh_path(spark, "rates"), keep=False, allow_late=False).drop("opened_us")


@query("aligned_windows", f"""SELECT user_id, strftime(time_bucket(INTERVAL 1 DAY, ts), {_TS}) AS opened_at, count(*) AS requests, least(count(*), 2) AS allowed, greatest(count(*) - 2, 0) AS throttled
FROM events GROUP BY ALL""")
def aligned_windows(spark, d):
    out = rates.aligned_windows(B.table(spark, d, "events"), "user_id", "ts", 2, _DAY)
    return out.withColumn("opened_at", F.date_format("opened_at", _OUT))


@query("deduplicated_stream", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y%m%d') AS day FROM events")
def deduplicated_stream(spark, d):
    """First sight of (user, type, day) over the arriving events."""
    stream = _stream(spark, d).withColumn("day", F.date_format("ts", "yyyyMMdd"))
    kept = jobs.dedupe_stream(stream, ["user_id", "event_type", "day"], "ts", "40 days")
    return jobs.run_available(kept.select("user_id", "event_type", "day", "ts"), fresh_path(spark, "dedupe"), keep=False, allow_late=False).drop("ts")


@query("upserted_stream", """SELECT user_id AS id, arg_max(event_type, event_id) AS status, strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S') AS first_seen,
  strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1""")
def upserted_stream(spark, d):
    """Micro-batches appended to a folder, read as an upserted state."""
    rows = _stream(spark, d).select(F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("status"),
                                    F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))
    folder = fresh_path(spark, "entities")
    jobs.append_stream(rows, folder).awaitTermination()
    for path in (folder, f"{folder}-progress"):
        expire(spark, path)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return tables.current(spark.read.parquet(folder), "id", ["event_id"], ("first_seen",)).select("id", "status", stamp("first_seen"), stamp("last_seen"))


_METRICS = """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS items,
  count(*) FILTER (value > 50) AS errors, round(sum(value), 4) AS total FROM events GROUP BY ALL"""


def _metric_rows(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                     "items", "errors", F.round("total", 4).alias("total"))


@query("stage_metrics", _METRICS)
def stage_metrics(spark, d):
    log = B.table(spark, d, "events").withColumn("bad", F.col("value") > 50)
    return _metric_rows(jobs.stage_metrics(log, "ts", "event_type", "value", "bad"))


@query("stage_metrics_stream", _METRICS)
def stage_metrics_stream(spark, d):
    """All windows so far, open ones included."""
    stream = _stream(spark, d).withColumn("bad", F.col("value") > 50)
    counted = jobs.stage_metrics(stream, "ts", "event_type", "value", "bad")
    return _metric_rows(jobs.run_updates(counted, fresh_path(spark, "metrics"), ["window_start", "event_type"], keep=False))


@query("compacted_stream", """SELECT user_id AS id, arg_max(event_type, event_id) AS status, strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S') AS first_seen,
  strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1""")
def compacted_stream(spark, d):
    """Batches appended to a folder, gathered twice on the way, one of them written again afterwards."""
    rows = B.table(spark, d, "events").select(
        F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("first_seen"),
        F.col("ts").cast("timestamp").alias("last_seen"))
    cut = (rows.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] + 7) // 7
    folder, arrived = fresh_path(spark, "batches"), rows.withColumn("number", F.floor(F.col("event_id") / cut))
    expire(spark, folder)
    for number in (0, 1, 2, 3, 4, 5, 6, 2):
        tables.append_batch(arrived.filter(F.col("number") == number).drop("number"), folder, number)
        tables.compact(spark, folder, "id", ["event_id"], ("first_seen",), threshold=3)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return tables.current(tables.batches(spark, folder), "id", ["event_id"], ("first_seen",)).select("id", "status", stamp("first_seen"), stamp("last_seen"))
