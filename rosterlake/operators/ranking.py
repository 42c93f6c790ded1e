"""Orderings, pages, top-k and positions that do not need one big window."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import materialise

DEFAULT_LIMIT, MAX_LIMIT = 50, 200


def _ordering(spec) -> list:
    """('-quality', 'name') -> [quality desc, name asc]."""
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in spec]


def ordered(df: DataFrame, spec) -> DataFrame:
    return df.orderBy(*_ordering(spec))


def top(df: DataFrame, spec, limit: int = 0, offset: int = 0) -> DataFrame:
    """Ordered slice; ``limit=0`` keeps everything.  With a limit Spark plans a
    per-partition top-k followed by a merge, never a full sort."""
    out = ordered(df, spec)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def page_bounds(page=1, limit=DEFAULT_LIMIT, max_limit=None):
    page = max(int(page), 1)
    limit = DEFAULT_LIMIT if int(limit) < 1 else int(limit)
    return page, limit if max_limit is None else min(limit, int(max_limit))


def page(df: DataFrame, spec, page_no=1, limit=DEFAULT_LIMIT, max_limit=None) -> DataFrame:
    """One page plus page metadata on every row (page, limit, total, total_pages).

    ``max_limit`` bounds the page size, as a service does (``MAX_LIMIT`` is the customary bound); by default there is
    none.  ``page_limit`` is the size that was applied.
    """
    page_no, limit = page_bounds(page_no, limit, max_limit)
    total = df.agg(F.count("*")).scalar()
    rows = top(df, spec, limit, (page_no - 1) * limit)
    return (rows.withColumn("page", F.lit(page_no)).withColumn("page_limit", F.lit(limit))
            .withColumn("total", total)
            .withColumn("total_pages", F.greatest(
                F.ceil(F.col("total") / F.lit(limit)), F.lit(1)).cast("long")))


def first_n_per_group(df: DataFrame, group, spec, n: int) -> DataFrame:
    """At most ``n`` rows per group.

    ``row_number <= n`` lets Spark drop surplus rows before the shuffle (window
    group limit), so a group with a third of all rows sends n rows per task.
    """
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(*_ordering(spec))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _ranged(df: DataFrame, group: str, spec, columns) -> DataFrame:
    """``columns`` range-partitioned and sorted by (group, order), with ``_at``, a number that grows in that order and
    holds the partition in its upper bits."""
    order = [F.asc(group)] + _ordering(spec)
    return (df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_at", F.monotonically_increasing_id()))


def _chunks(placed: DataFrame, group: str, carry=()) -> DataFrame:
    """(group, partition) -> ``_shift`` from ``_at`` to the position in the group, and as ``_carry`` the ``carry``
    columns of the group's last row in the partition before."""
    rows = placed.groupBy(F.col(group).alias("_g"), "_part").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows"), F.max_by(F.struct(F.lit(1).alias("_one"), *carry), "_at").alias("_last"))
    # ordered partitions of one group: running sums over chunks only, at most (partitions + groups) rows
    w = Window.partitionBy("_g").orderBy("_part")
    before = F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("_g", F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"),
                       F.lag("_last").over(w).alias("_carry"))


def _with_chunks(placed: DataFrame, group: str, carry=()) -> DataFrame:
    same = placed[group].eqNullSafe(F.col("_g")) & (placed["_part"] == F.col("_p"))
    return placed.join(_chunks(placed, group, carry), same, "left")


def positions(df: DataFrame, group: str, spec, out="position", columns=None) -> DataFrame:
    """1..n inside every group, for groups of any size.

    A window per group would sort each group in a single task.  Instead the
    whole frame is range-partitioned by (group, order), each row gets its place
    within its partition, and the partitions' group counts supply the offsets.
    ``spec`` must end in a unique column.  The sorted rows are stored in the
    shared folder, as their partitions must not change between counting and
    numbering.
    """
    columns = columns or df.columns
    placed = materialise(_ranged(df, group, spec, columns).withColumn("_part", F.shiftright("_at", 33)), "positions")
    return _with_chunks(placed, group).select(*columns, (F.col("_at") + F.col("_shift")).alias(out))


def _before(group, columns):
    """Adds to sorted batches ``_same`` (the row before belongs to the same group) and that row's ``columns``."""
    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(dict.fromkeys([group, *columns]))
            rows = pa.table({n: batch.column(batch.schema.get_field_index(n)) for n in names})    # all nullable
            if last is None:
                last = pa.table({n: pa.nulls(1, rows.schema.field(n).type) for n in rows.column_names})
                known = False
            else:
                known = True
            ahead = pa.concat_tables([last, rows.slice(0, rows.num_rows - 1)]).combine_chunks()
            a, b = rows.column(group), ahead.column(group)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).combine_chunks()
            if not known:
                same = pa.concat_arrays([pa.array([False]), same.slice(1)])
            nulls = [pa.nulls(rows.num_rows, rows.schema.field(c).type) for c in columns]
            shifted = [pc.if_else(same, ahead.column(c).combine_chunks(), n) for c, n in zip(columns, nulls)]
            yield pa.RecordBatch.from_arrays([*batch.columns, same, *shifted],
                                             names=[*batch.schema.names, "_same", *[f"previous_{c}" for c in columns]])
            last = rows.slice(rows.num_rows - 1, 1)
    return run


def with_previous(df: DataFrame, group: str, spec, columns, out="position") -> DataFrame:
    """Position inside the group plus ``previous_<column>`` of the row before.

    The predecessor of a row is the row above it in its range-sorted partition;
    only the first row of a (group, partition) looks into a small table of the
    partitions' last rows.  One long history spreads over all tasks, and the
    rows are shuffled once.
    """
    columns = list(columns)
    ranged = _ranged(df, group, spec, df.columns)
    schema = T.StructType(list(ranged.schema.fields)).add("_same", T.BooleanType())
    for c in columns:
        schema = schema.add(f"previous_{c}", df.schema[c].dataType)
    placed = materialise(ranged.mapInArrow(_before(group, columns), schema)
                         .withColumn("_part", F.shiftright("_at", 33)), "positions")
    before = [F.when(F.col("_same"), F.col(f"previous_{c}")).otherwise(F.col("_carry")[c]).alias(f"previous_{c}") for c in columns]
    return _with_chunks(placed, group, columns).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out), *before)


def counts_desc(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), F.asc(column))
