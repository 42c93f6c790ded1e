"""Streaming ingest, de-duplication, request windows and stage metrics."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import expire
from ..sinks import tables


def file_stream(spark: SparkSession, path: str, schema, pattern: str = None, per_trigger: int = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def late_rows(query) -> int:
    """Rows that a query has dropped, in its recent batches, as later than its watermark."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def _done(stream: DataFrame, out: str, keep: bool):
    for path in () if keep else (out, f"{out}-progress"):
        expire(stream.sparkSession, path)


def run_available(stream: DataFrame, out: str, keep=True, allow_late=True) -> DataFrame:
    """Runs a stream over what has arrived and returns what it wrote.

    ``out`` is a folder that all executors share; progress is kept beside it.
    With ``keep=False`` both go when the session ends.  ``allow_late=False``
    fails a run that has dropped late rows.
    """
    query = (stream.writeStream.outputMode("append").format("parquet")
             .option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out))
    query.awaitTermination()
    if not allow_late and (late := late_rows(query)):
        raise RuntimeError(f"{late} rows came later than the watermark and were dropped")
    _done(stream, out, keep)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def append_stream(stream: DataFrame, out: str, mode="append"):
    """Appends each micro-batch to the folder ``out`` under its number; a replayed
    batch replaces itself.  ``tables.current`` reads the state."""
    def apply(batch: DataFrame, epoch: int):
        tables.append_batch(batch, out, int(epoch))

    return (stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", f"{out}-progress")
            .trigger(availableNow=True).start())


def run_updates(stream: DataFrame, out: str, key, order=(), keep=True) -> DataFrame:
    """Latest row per key of a stream in update mode: rows of open windows are there too."""
    append_stream(stream, out, "update").awaitTermination()
    _done(stream, out, keep)
    log = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return tables.current(log, key, order, ())


def dedupe_stream(stream: DataFrame, key, ts: str, delay="1 hour") -> DataFrame:
    """First row per key; keys are forgotten ``delay`` after their last event."""
    keys = [key] if isinstance(key, str) else list(key)
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rate_stream(stream: DataFrame, key: str, ts: str, event_id: str, limit: int, seconds=60,
                delay="1 hour") -> DataFrame:
    """Verdict per request with windows opened by the key's first request.

    Rows that arrive more than ``delay`` late are dropped by the watermark, as
    in any windowed stream; ``request_verdicts`` judges them in batch.  State
    per key is two numbers, dropped once the watermark (``delay`` behind
    the newest event) has passed the window: the next request would open a new
    one anyway.  A key's rows are ordered within the micro-batch, whose size
    the source bounds.
    """
    width = int(seconds * 1_000_000)
    kind = dict(stream.dtypes)[key]
    id_kind = dict(stream.dtypes)[event_id]

    def fold(group, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["us", event_id], kind="stable")
        us, at = rows["us"].to_numpy(), 0
        place, opens = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
        while at < len(us):     # one step per window, not per request
            if opened is None or us[at] > opened + width:
                opened, used = int(us[at]), 0
            stop = int(np.searchsorted(us, opened + width, side="right"))
            place[at:stop] = used + np.arange(stop - at)
            opens[at:stop] = opened
            used, at = min(used + stop - at, limit), stop
        verdicts = place < limit
        state.update((opened, used))
        closes = (opened + width) // 1000 + 1
        state.setTimeoutTimestamp(max(closes, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]] * len(rows), event_id: rows[event_id].to_numpy(),
                            "opened_us": opens, "allowed": verdicts})

    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (timed.select(key, event_id, ts, F.unix_micros(ts).alias("us"))
            .groupBy(key).applyInPandasWithState(
                fold, f"{key} {kind}, {event_id} {id_kind}, opened_us long, allowed boolean",
                "opened long, used long", "append", GroupStateTimeout.EventTimeTimeout))


def stage_metrics(stream: DataFrame, ts: str, stage: str, value: str, error: str, window="1 hour",
                  delay="10 minutes") -> DataFrame:
    """Items, errors and times per stage and window; works on streams and on
    batch frames alike (the watermark only matters for streams)."""
    if stream.isStreaming:
        stream = stream.withWatermark(ts, delay)
    return (stream.groupBy(F.window(ts, window).alias("w"), stage).agg(
        F.count("*").alias("items"), F.count_if(F.col(error)).alias("errors"),
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), stage, "items", "errors", "first_at", "last_at", "total"))
