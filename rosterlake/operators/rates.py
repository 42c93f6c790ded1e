"""Request windows per key.

A key's window opens with the first request outside the previous window, so
windows follow the traffic, unlike ``F.window``, which is aligned to the epoch
and answers a different question (``aligned_windows`` offers it by name).

Where a window opens depends on all earlier ones of the key.  The requests are
sorted by key and time and cut into blocks of equal numbers of rows, so one
busy key, one crowded hour or one crowded microsecond fills as many blocks as
its rows need:

1. every block becomes a function of its last key's requests: for each event
   that may open the first window there, where the last window ends and how
   much of it is used;
2. functions of neighbouring blocks are composed in log2(blocks) levels.  A
   window that ends beyond its block lands in a later one, and the pairs of
   (block, block landed in) form a staircase, so each level deals out pairs of
   blocks and no task gets more than two;
3. from the top down every block learns the window that is open when it
   begins, and then labels its own rows with array operations.

What the driver holds is a few numbers per block.  Rows with a null key are a
key of their own; rows with an unknown time belong to no window.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

_NO_CARRY = -(1 << 62)
ROWS = 2_000_000       # of a block, about


def _key(column: Column) -> Column:
    """Key as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _unkey(column: Column, kind: str) -> Column:
    return F.when(column != "", F.substr(column, F.lit(2))).cast(kind)


def _in_blocks(rows: DataFrame, order, blocks: int = None) -> DataFrame:
    """``rows`` (k, us, ...) with ``b``, the number of their block in the order of (k, us, *order); written."""
    if blocks is None:
        blocks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / ROWS))
    dealt = rows.repartitionByRange(blocks, "k", "us", *order)
    return materialise(dealt.withColumn("b", F.spark_partition_id()), "requests")


def _by_block(stored: DataFrame, *order) -> DataFrame:
    return stored.repartition("b").sortWithinPartitions("b", "k", "us", *order).groupBy("b")


# ---- arrays of one block ----------------------------------------------------------------------------------------------

def _starts(k: np.ndarray) -> np.ndarray:
    """First row of every key."""
    return np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))


def _next_opener(us: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For a window opened by each row, the row that opens the following one; its own key's, else ``len(us)``."""
    gaps = np.minimum(np.diff(us, prepend=us[:1]), width + 1)   # longer gaps end a window all the same
    gaps[starts] = width + 1
    at = np.cumsum(gaps)
    after = np.searchsorted(at, at + width, side="right")
    ends = np.append(starts[1:], len(us))[np.searchsorted(starts, np.arange(len(us)), side="right") - 1]
    return np.where(after < ends, after, len(us))


def _openers(us: np.ndarray, starts: np.ndarray, width: int, carry: int) -> np.ndarray:
    """Rows that open a window, when the first key comes with a window that ends at ``carry``."""
    n = len(us)
    jump = np.append(_next_opener(us, starts, width), n)
    end = starts[1] if len(starts) > 1 else n
    first = int(np.searchsorted(us[:end], carry, side="right"))
    reached = np.zeros(n + 1, bool)
    reached[np.append(starts[1:], first if first < end else n)] = True
    while True:                                  # after t rounds the first 2 ** t windows of every key are known
        more = jump[np.flatnonzero(reached)]
        if reached[more].all():
            break
        reached[more] = True
        jump = jump[jump]
    return np.flatnonzero(reached[:n])


def _labelled(k, us, w, width: int, carry: int, used: int):
    """(opening time, requests before in the same window) of every row."""
    opens = _openers(us, _starts(k), width, carry)
    sums = np.concatenate(([0], np.cumsum(w)))
    own = np.searchsorted(opens, np.arange(len(us)), side="right") - 1
    covered = own < 0
    row = opens[own] if len(opens) else np.zeros(len(us), np.int64)
    return np.where(covered, carry - width, us[row]), np.where(covered, used + sums[:-1], sums[:-1] - sums[row])


def _leaf(width: int):
    """Edges of a block (kind 0: its first and its last key) and the function of its last key (kind 1)."""
    def leaf(key, table):
        k, us = table["k"].to_numpy(), table["us"].to_numpy()
        sums = np.concatenate(([0], np.cumsum(table["w"].to_numpy())))
        starts = _starts(k)
        lo, n = int(starts[-1]), len(us)
        last = np.append(_next_opener(us, starts, width), n)
        last = np.where(last < n, last, np.arange(n + 1))
        while True:                              # pointer doubling: the last opener of every chain
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        # a window that comes in ends at most ``width`` after the first event
        most = lo + int(np.searchsorted(us[lo:], us[lo] + width, side="right")) + 1 if lo == 0 else lo + 1
        cand = lo + np.flatnonzero(np.diff(us[lo:most], prepend=us[lo] - 1))
        first_end = int(starts[1]) if len(starts) > 1 else n
        edge = [(k[0], us[0], us[first_end - 1], sums[first_end]), (k[lo], us[lo], us[-1], sums[n] - sums[lo])]
        edges = pd.DataFrame(edge, columns=["k", "cand", "exit", "used"]).assign(b=key[0].as_py(), kind=0)
        function = pd.DataFrame({"k": None, "cand": us[cand], "exit": us[last[cand]] + width, "used": sums[n] - sums[last[cand]],
                                 "b": key[0].as_py(), "kind": 1})
        both = pd.concat([edges, function], ignore_index=True)
        return pa.Table.from_pandas(both[["kind", "k", "b", "cand", "exit", "used"]], _EDGES, preserve_index=False)
    return leaf


_EDGES = pa.schema([("kind", pa.int32()), ("k", pa.string()), ("b", pa.int32()), ("cand", pa.int64()), ("exit", pa.int64()), ("used", pa.int64())])
_LEAF = "kind int, k string, b int, cand long, exit long, used long"
_FUNCTION = "b int, cand long, exit long, used long"


# ---- functions of many blocks -----------------------------------------------------------------------------------------

class _Chains:
    """Runs of blocks that one key fills: per block its place ``at`` in the run, the run's ``first`` block, the number
    ``size`` of blocks with functions, and the last time and the requests of the block's last key."""

    def __init__(self, edges: pd.DataFrame):
        # two edges per block, its first key's and its last key's; blocks without rows have none
        edges = edges.sort_values(["b", "k", "cand"], kind="stable")
        first, last = edges.iloc[0::2], edges.iloc[1::2]
        self.block = first["b"].to_numpy()
        n = len(self.block)
        goes_on = np.append(last["k"].to_numpy()[:-1] == first["k"].to_numpy()[1:], False) if n else np.zeros(0, bool)
        single = (first["k"].to_numpy() == last["k"].to_numpy()) if n else np.zeros(0, bool)
        self.last_us, self.requests = last["exit"].to_numpy(), np.concatenate(([0], np.cumsum(last["used"].to_numpy())))
        self.first, self.size = np.arange(n), np.zeros(n, np.int64)
        for i in range(1, n):
            if goes_on[i - 1] and single[i] and goes_on[i]:
                self.first[i] = self.first[i - 1]
        runs, counts = np.unique(self.first[goes_on], return_counts=True)
        self.runs = dict(zip(runs.tolist(), counts.tolist()))   # first place of a run -> blocks with functions
        for i in np.flatnonzero(goes_on):
            self.size[i] = self.runs[int(self.first[i])]
        self.levels = max((int(m).bit_length() for m in counts), default=0)

    def sibling(self, i: int, level: int):
        """Places of the right sibling of the group that place ``i`` belongs to; empty if that is on the right itself."""
        first, group = int(self.first[i]), (i - int(self.first[i])) >> level
        if group & 1:
            return 0, 0
        most = first + int(self.size[i])
        return min(first + ((group + 1) << level), most), min(first + ((group + 2) << level), most)

    def land(self, ends: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """First place in lo..hi with an event after each of ``ends``; ``hi`` if none has."""
        return lo + np.searchsorted(self.last_us[lo:hi], ends, side="right")


def _further(chains: _Chains, level: int):
    """Where every entry's window lands in the group to the right: ``to``, or -1 where nothing is left to look up."""
    place = {int(b): i for i, b in enumerate(chains.block)}

    def further(batches):
        for pdf in batches:
            pdf = pdf.assign(to=np.int32(-1))
            for b, rows in pdf.groupby("b").indices.items():
                i = place[int(b)]
                lo, hi = chains.sibling(i, level)
                if chains.size[i] == 0 or lo >= hi:
                    continue
                to = chains.land(pdf["exit"].to_numpy()[rows], lo, hi)
                over = to == hi
                used = pdf["used"].to_numpy().copy()
                used[rows[over]] += chains.requests[hi] - chains.requests[lo]
                targets = pdf["to"].to_numpy().copy()
                targets[rows[~over]] = chains.block[to[~over]]
                pdf = pdf.assign(used=used, to=targets)
            yield pdf
    return further


def _land(key, pdf):
    """Entries of one block looked up in the function of the block they land in."""
    entry = pdf["x"].isna().to_numpy()
    known = pdf[~entry].sort_values("cand")
    mine = pdf[entry]
    at = np.searchsorted(known["cand"].to_numpy(), mine["exit"].to_numpy(), side="right")
    return pd.DataFrame({"b": mine["b"].to_numpy(), "cand": mine["cand"].to_numpy(), "exit": known["exit"].to_numpy()[at],
                         "used": known["used"].to_numpy()[at]})


def _composed(level0: DataFrame, chains: _Chains) -> list:
    """Functions of groups of 1, 2, 4, ... blocks, by the block of their entries."""
    levels = [level0]
    for level in range(chains.levels - 1):
        now = levels[-1]
        told = materialise(now.mapInPandas(_further(chains, level), _FUNCTION + ", to int"), "windows")
        landing = told.filter("to >= 0")
        pairs = landing.select("b", "to").distinct()
        known = now.select(F.col("b").alias("to"), "cand", "exit", "used", F.lit(1).alias("x")).join(pairs, "to")
        looked_up = (landing.withColumn("x", F.lit(None).cast("int")).unionByName(known)
                     .groupBy("b", "to").applyInPandas(_land, _FUNCTION))
        levels.append(materialise(told.filter("to < 0").drop("to").unionByName(looked_up), "windows"))
    return levels


def _carries(levels: list, chains: _Chains) -> dict:
    """{block: (end of the window that is open when it begins, requests it has had)} of the blocks a key goes on in."""
    spark = levels[0].sparkSession
    state = {(first, first): (_NO_CARRY, 0) for first in chains.runs}    # (run, place a group begins at) -> carry
    for level in range(chains.levels - 1, -1, -1):
        asked, known = [], {}
        for (run, i), (end, used) in state.items():
            right = i + (1 << level)
            if right > run + chains.runs[run]:
                continue                                         # the run has nothing in the group's right half
            to = int(chains.land(np.array([end]), i, right)[0])
            if to == right:
                known[run, right] = (end, used + int(chains.requests[right] - chains.requests[i]))
            else:
                asked.append((run, right, int(chains.block[to]), end))
        if asked:
            wanted = spark.createDataFrame(asked, "run long, place long, b int, after long")
            found = (levels[level].join(wanted, "b").filter("cand > after").groupBy("run", "place")
                     .agg(F.min(F.struct("cand", "exit", "used")).alias("f")).collect())
            known.update({(r["run"], r["place"]): (r["f"]["exit"], r["f"]["used"]) for r in found})
        state.update(known)
    return {int(chains.block[i]): carry for (run, i), carry in state.items() if i != run}


def _block_carries(stored: DataFrame, width: int) -> dict:
    leaves = materialise(_by_block(stored.select("b", "k", "us", "w")).applyInArrow(_leaf(width), _LEAF), "windows")
    chains = _Chains(leaves.filter("kind = 0").select("b", "k", "cand", "exit", "used").toPandas())
    return _carries(_composed(leaves.filter("kind = 1").select("b", "cand", "exit", "used"), chains), chains) if chains.levels else {}


# ---- results ------------------------------------------------------------------------------------------------------------

def _labels(width: int, carries: dict, verdicts: bool):
    def label(key, table):
        end, used = carries.get(key[0].as_py(), (_NO_CARRY, 0))
        us, w = table["us"].to_numpy(), table["w"].to_numpy()
        opened, before = _labelled(table["k"].to_numpy(), us, w, width, end, used)
        if verdicts:
            return table.select(["row"]).append_column("place", pa.array(before + 1))
        return pa.table({"k": table["k"], "us": us, "requests": w, "open_us": opened, "before": before})
    return label


def window_labels(df: DataFrame, key: str, ts: str, seconds=60, blocks: int = None) -> DataFrame:
    """(k, us, requests, open_us, before): distinct event times with their window; ``k`` is the key as text."""
    width = int(seconds * 1_000_000)
    instants = (df.filter(F.col(ts).isNotNull())
                .groupBy(_key(F.col(key)).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
                .agg(F.count("*").alias("w")))
    stored = _in_blocks(instants, (), blocks)
    return _by_block(stored).applyInArrow(_labels(width, _block_carries(stored, width), False),
                                          "k string, us long, requests long, open_us long, before long")


def key_opened_windows(df: DataFrame, key: str, ts: str, limit: int, seconds=60, blocks: int = None) -> DataFrame:
    """One row per window: opened_at, requests, allowed, throttled."""
    labels = window_labels(df, key, ts, seconds, blocks)
    return (labels.groupBy("k", "open_us").agg(F.sum("requests").alias("requests"))
            .select(_unkey(F.col("k"), dict(df.dtypes)[key]).alias(key), F.timestamp_micros("open_us").alias("opened_at"), "requests",
                    F.least("requests", F.lit(limit)).alias("allowed"),
                    F.greatest(F.col("requests") - limit, F.lit(0)).alias("throttled")))


def request_verdicts(df: DataFrame, key: str, ts: str, event_id: str, limit: int, seconds=60, blocks: int = None) -> DataFrame:
    """Every request with its ``place`` in the window and ``allowed``; the order
    inside a window is time, then id.  A request with an unknown time has
    neither.

    Requests are sorted once, over all tasks, and places are running numbers of
    that order: nothing is grouped by window, key or instant.
    """
    width = int(seconds * 1_000_000)
    rows = df.select(F.struct(*df.columns).alias("row"), _key(F.col(key)).alias("k"),
                     F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(event_id).alias("id"), F.lit(1).cast("long").alias("w"))
    timed = rows.filter("us is not null").withColumn("n", F.monotonically_increasing_id())
    stored = _in_blocks(timed, ("id", "n"), blocks)
    kind = rows.select("row").schema["row"].dataType.simpleString()
    known = _by_block(stored, "id", "n").applyInArrow(_labels(width, _block_carries(stored, width), True), f"row {kind}, place long")
    unknown = rows.filter("us is null").select("row", F.lit(None).cast("long").alias("place"))
    return known.unionByName(unknown).select("row.*", "place").withColumn("allowed", F.col("place") <= limit)


def aligned_windows(df: DataFrame, key: str, ts: str, limit: int, seconds=60) -> DataFrame:
    """Epoch-aligned windows: a different, cheaper answer."""
    return (df.groupBy(key, F.window(ts, f"{int(seconds)} seconds").alias("w"))
            .agg(F.count("*").alias("requests"))
            .select(key, F.col("w.start").alias("opened_at"), "requests",
                    F.least("requests", F.lit(limit)).alias("allowed"),
                    F.greatest(F.col("requests") - limit, F.lit(0)).alias("throttled")))
