"""Pages of a listing from an order index: deep pages cost what the first one costs.

The listing is range partitioned by its order once and written as parts, with the last row of each; the driver keeps the number of rows per part.
A page by number is in the one or two parts that its positions fall into, a page by key (the rows after a given one) in
the part that the key falls into and, where that ends, the next; only these parts are read and sorted.  The total is
the sum of the parts' counts.  Parts hold about equal numbers of rows, whatever the order's columns hold.

Orders are written as ``('-quality', 'name')``: descending with nulls last, ascending with nulls first.  They must end in
columns that tell rows apart, else rows that tie may come in another order on another page.
"""

import bisect
import itertools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from . import ranking

PART_ROWS = 100_000


class OrderIndex(NamedTuple):
    table: DataFrame     # the listing's rows with their part
    spec: tuple
    part: str            # name of the part column
    ends: list           # rows up to the end of each part, by part
    bounds: DataFrame    # the last row of each part, by the order's columns

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0


def order_index(df: DataFrame, spec, part_rows=PART_ROWS) -> OrderIndex:
    """Writes ``df`` in parts of its order, of about ``part_rows`` rows each."""
    name = "part"
    while name in df.columns:
        name += "_"
    parts = max(1, math.ceil(df.count() / part_rows))
    dealt = df.repartitionByRange(parts, *ranking._ordering(spec)).withColumn(name, F.spark_partition_id())
    table = materialise(dealt, "listing", partition_by=[name])
    counts = {r[0]: r[1] for r in table.groupBy(name).count().collect()}
    ends = list(itertools.accumulate(counts.get(i, 0) for i in range(max(counts, default=-1) + 1)))
    columns = dict.fromkeys(c.removeprefix("-") for c in spec)
    backwards = [F.asc_nulls_first(c[1:]) if c.startswith("-") else F.desc_nulls_last(c) for c in spec]
    place = F.row_number().over(Window.partitionBy(name).orderBy(*backwards))
    bounds = table.select(name, *columns, place.alias(name + "_place")).filter(F.col(name + "_place") == 1).drop(name + "_place")
    return OrderIndex(table, tuple(spec), name, ends, materialise(bounds, "bounds"))


def _page(index: OrderIndex, parts: range, rows: DataFrame, limit: int, offset=0) -> DataFrame:
    own = rows.filter(F.col(index.part).between(parts.start, parts.stop - 1)).drop(index.part)
    return ranking.top(own, index.spec, limit, offset)


def page(index: OrderIndex, page_no=1, limit=ranking.DEFAULT_LIMIT, max_limit=None) -> DataFrame:
    """The page of a number, with the columns that ``ranking.page`` adds."""
    page_no, limit = ranking.page_bounds(page_no, limit, max_limit)
    start = (page_no - 1) * limit
    first = bisect.bisect_right(index.ends, start)
    last = bisect.bisect_left(index.ends, start + limit)
    before = index.ends[first - 1] if first else 0
    rows = _page(index, range(first, min(last + 1, len(index.ends))), index.table, limit, min(start - before, (1 << 31) - 1))
    return rows.withColumns({"page": F.lit(page_no), "page_limit": F.lit(limit), "total": F.lit(index.total).cast("long"),
                             "total_pages": F.lit(max(1, -(-index.total // limit))).cast("long")})


def comes_after(spec, values) -> Column:
    """Whether a row stands behind the one with these values of the order's columns."""
    later = F.lit(False)
    for c, v in reversed(list(zip(spec, values, strict=True))):
        column, down = F.col(c.removeprefix("-")), c.startswith("-")
        if v is None:
            beyond = F.lit(False) if down else column.isNotNull()
        else:
            beyond = (column < F.lit(v)) | column.isNull() if down else column > F.lit(v)
        later = F.coalesce(beyond, F.lit(False)) | (column.eqNullSafe(F.lit(v)) & later)
    return later


def after(index: OrderIndex, values, limit=ranking.DEFAULT_LIMIT) -> DataFrame:
    """The ``limit`` rows behind the row with these values; the row itself need not exist."""
    behind = comes_after(index.spec, values)
    first = index.bounds.filter(behind).agg(F.min(index.part)).first()[0]    # the first part that reaches beyond the key
    if first is None:
        return index.table.filter("false").drop(index.part)
    done, last = index.ends[first], first
    while last + 1 < len(index.ends) and index.ends[last] - done < limit:
        last += 1
    return _page(index, range(first, last + 1), index.table.filter(behind), limit)
