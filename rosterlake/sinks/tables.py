"""Table maintenance without a transactional table format.

Frame functions compute a new state from an old one, or from a folder of
appended change batches.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import ranking
from ..operators.resolve import latest_per_key
from ..session import materialise

KEEP = ("first_seen", "created_at")


def upsert(target: DataFrame, updates: DataFrame, key, keep=KEEP, order=None) -> DataFrame:
    """Rows of ``updates`` replace rows of ``target`` with the same key, except
    the ``keep`` columns, which stay as first written.

    ``order`` picks the latest of several updates for one key.  One full join on
    the key reads the target and the updates once each, whatever either of them
    takes to compute.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = target.columns
    fresh = updates if order is None else latest_per_key(updates, keys, order)
    new = fresh.select(*keys, F.struct(*[c for c in cols if c not in keys]).alias("_new"))

    def value(c):
        if c in keys:
            return F.col(c)
        n = F.col("_new")[c]
        if c in keep:
            return F.coalesce(F.col(c), n).alias(c)
        return F.when(F.col("_new").isNotNull(), n).otherwise(F.col(c)).alias(c)

    return target.join(new, keys, "full").select(*[value(c) for c in cols])


def upsert_log(log: DataFrame, key, order, first=KEEP) -> DataFrame:
    """Final state of a whole change log in one aggregation: latest row per key,
    earliest value of the ``first`` columns."""
    keys = [key] if isinstance(key, str) else list(key)
    firsts = [c for c in first if c in log.columns]
    rest = [c for c in log.columns if c not in keys and c not in firsts]
    ordering = F.struct(*order)
    return (log.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), ordering).alias("_last"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), ordering)).alias(c) for c in firsts])
        .select(*keys, *firsts, "_last.*"))


def insert_new(target: DataFrame, rows: DataFrame, key) -> DataFrame:
    """Insert-or-ignore: rows whose key is already there are dropped; of several
    new rows with one key the smallest is taken, so reruns agree."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    distinct = (rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
                if rest else rows.distinct())
    return target.unionByName(distinct.join(target.select(*keys), keys, "left_anti"))


def delete(target: DataFrame, gone: DataFrame, key) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    # one row per key: a key repeated many times must not crowd one task
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")


def history(target: DataFrame, key: str, order) -> DataFrame:
    """Snapshots of each key numbered in order, with the previous one's time.

    ``order`` starts with the time column and ends in a unique one.
    """
    return ranking.with_previous(target, key, order, [order[0]], out="sequence")


def snapshot_changes(target: DataFrame, key: str, order, columns) -> DataFrame:
    """Snapshots whose ``columns`` differ from the key's previous snapshot."""
    numbered = ranking.with_previous(target, key, order, columns, out="sequence")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"previous_{c}"))
    return numbered.filter((F.col("sequence") == 1) | changed).select(*target.columns)


def migration_log(rows: DataFrame, ok: Column, message: Column, old_id="id", new_id: Column = None) -> DataFrame:
    """Status row per migrated row; good and bad rows in one pass."""
    return rows.select(
        F.col(old_id).alias("old_id"),
        F.when(ok, F.col(old_id) if new_id is None else new_id).alias("new_id"),
        F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(~ok, message).alias("error_message"))


def run_history(runs: DataFrame, started="started_at", key="crawl_id") -> DataFrame:
    return runs.orderBy(F.desc(started), F.asc(key))


def append_history(rows: DataFrame, path: str, run_column="crawl_id"):
    """Append-only write, one folder per run."""
    rows.write.mode("append").partitionBy(run_column).parquet(path)


def backup_once(spark: SparkSession, source: DataFrame, path: str) -> bool:
    """Copies ``source`` unless the target already holds a finished copy."""
    if _exists(spark, f"{path}/_SUCCESS"):
        return False
    source.write.mode("overwrite").parquet(path)
    return True


def _path(spark, path):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark, path):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark, path) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def append_batch(batch: DataFrame, path: str, number: int, column="batch"):
    """One batch of changes as a partition of a plain folder; the same batch written again replaces itself."""
    (batch.withColumn(column, F.lit(number).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))


def current(log: DataFrame, key, order, first=KEEP, batch="batch") -> DataFrame:
    """State after all batches of a change folder: later batches win, ``order`` decides within one."""
    in_batch = [F.col(c) if isinstance(c, str) else c for c in order]
    return upsert_log(_numbered(log, batch), key, [F.col(batch), *in_batch], first).drop(batch)


# folder value of rows that ``compact`` has gathered, and the column with the batch that each of them came in
BASE, CAME_IN = -1, "came_in"


def _numbered(log: DataFrame, batch="batch") -> DataFrame:
    """``log`` with the batch that each row came in, also for gathered rows."""
    return log.withColumn(batch, F.coalesce(CAME_IN, batch)).drop(CAME_IN) if CAME_IN in log.columns else log


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The change folder's rows, gathered ones included."""
    return spark.read.option("mergeSchema", True).parquet(path)


def compact(spark: SparkSession, path: str, key, order, first=KEEP, batch="batch", threshold=64) -> bool:
    """Gathers the batches of a change folder in one partition once there are ``threshold`` of them.

    Of every key the rows stay that decide its state: the latest one and, for each of the ``first`` columns, the earliest
    that has a value, each with the number of its batch.  So a batch written again later changes nothing, and neither does
    a run that ends between writing the gathered rows and deleting the batches.  Returns whether it gathered.
    """
    log = batches(spark, path)
    numbers = sorted(r[0] for r in log.select(batch).distinct().collect() if r[0] != BASE)
    if len(numbers) < threshold:
        return False
    keys = [key] if isinstance(key, str) else list(key)
    rows = _numbered(log, batch)
    columns = rows.columns
    row = F.struct(*columns)
    at = F.struct(batch, *order)
    deciding = [F.max_by(row, at), *[F.min_by(row, F.when(F.col(c).isNotNull(), at)) for c in first if c in columns]]
    kept = (rows.groupBy(*keys).agg(F.array_distinct(F.array_compact(F.array(*deciding))).alias("_rows"))
            .select(F.explode("_rows").alias("_row")).select("_row.*"))
    staged = materialise(kept.withColumnRenamed(batch, CAME_IN).withColumn(batch, F.lit(BASE).cast("long")), "gathered")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)
    for number in numbers:
        _fs(spark, path).delete(_path(spark, f"{path.rstrip('/')}/{batch}={number}"), True)
    return True
