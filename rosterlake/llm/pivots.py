"""Exact top-k search by inner product: a pivot table eliminates candidates before their scores are computed.

Vectors become integers, floor(256 x).  ``PIVOTS`` of them, chosen far apart from a bounded sample, are the pivots; the
table stores every vector's Euclidean distance to each.  For a query q and a candidate x every pivot p bounds their
distance from below by |d(q, p) - d(x, p)|; the largest of these bounds gives the least upper bound of the score,
(|q|^2 + |x|^2 - bound^2) / 2.  Candidates are evaluated by descending bound until the next bound is below the k-th
score, so the result is exact whatever the pivots are.

The table is range partitioned into chunks of near-by vectors of at most about ``CHUNK`` rows, at least ``LEAST_CHUNKS``.
Every query first gets a floor, its k-th score in the sample, and goes to those chunks only whose ranges of
distances admit a score that high.  A task holds one chunk and a batch of queries; it returns at most k rows a query,
and the best of these are the result.

* A vector that is null, or holds a null or a component that is not finite, takes no part.
* Vectors of different lengths are compared as if the shorter one ended in zeros; an empty vector scores 0.
* Repeated rows are candidates of each other; every query row gives its own result.  A null id is no query, and is
  behind all others in a tie.  An empty table gives an empty result.
* Scores are 64-bit; vectors that may exceed them raise an OverflowError.
* Only the two named columns are read; other columns, whatever their names, are not.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import in_arrow
from .sampling import thinned

SCALE = 256
PIVOTS = 32
SAMPLE = 2000          # rows from which pivots are chosen, and that give queries their first floor
CHUNK = 65_536         # candidates that a task holds
LEAST_CHUNKS = 16
RANGES = 50_000        # runs of chunks whose ranges of distances reach every task
QUERIES = 64           # queries bounded at a time
FIRST = 64             # candidates evaluated first; four times as many in each later step
SLACK = 1e-6           # of the distances, given way to rounding
MOST = 2.0 ** 62

TABLE = "vec_id long, v array<long>, norm double, far array<float>, cell int"
DEALT = "chunk int, vec_id long, row long, v array<long>, norm double, far array<float>, floor double"


def matrix(lists: pa.Array, width=None) -> np.ndarray:
    """Rows of a list column side by side, ended by zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    widest = int(sizes.max(initial=0)) if width is None else width
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), widest), flat.dtype)
    if len(flat):
        row = np.repeat(np.arange(len(lists)), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = at < widest
        out[row[inside], at[inside]] = flat[inside]
    return out


def as_lists(rows: np.ndarray, kind) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def usable(column: pa.Array) -> np.ndarray:
    """Rows that hold a vector of finite components."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    values = column.flatten().cast(pa.float64(), safe=False)
    bad = ~np.isfinite(values.fill_null(np.nan).to_numpy(zero_copy_only=False))
    broken = np.bincount(np.repeat(np.arange(len(column)), sizes)[bad], minlength=len(column)) > 0
    return there & ~broken


def quantised(column: pa.Array) -> pa.Array:
    """floor(256 x) of every component, as lists of longs."""
    values = np.floor(SCALE * column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False))
    if len(values) and np.abs(values).max() >= MOST:
        raise OverflowError("a component does not fit 64 bits")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)))


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(rows.shape[1], pivots.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(float)
    rows, pivots = pad(rows), pad(pivots)
    out = np.empty((len(rows), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((rows - p) ** 2).sum(axis=1))
    return out


def far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` different rows, each the farthest from those before it."""
    if not len(rows):
        return rows
    chosen = [0]
    nearest = distances(rows, rows[:1])[:, 0]
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products, rows x queries."""
    width = min(rows.shape[1], queries.shape[1])
    rows, queries = rows[:, :width], queries[:, :width]
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    if top >= MOST:
        raise OverflowError("a score may not fit 64 bits")
    if top < 2.0 ** 53:  # sums of such products are exact in doubles
        return (rows.astype(float) @ queries.astype(float).T).astype(np.int64)
    return rows.astype(np.int64) @ queries.astype(np.int64).T


def _tabled(pivots: np.ndarray):
    def tabled(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            keep = pa.array(usable(column))
            ids, lists = ids.filter(keep), quantised(column.filter(keep))
            rows = matrix(lists)
            far = distances(rows, pivots)
            yield pa.RecordBatch.from_arrays(
                [ids, lists, pa.array((rows.astype(float) ** 2).sum(axis=1)), as_lists(far, pa.float32()),
                 pa.array(far.argmin(axis=1) if far.shape[1] else np.zeros(len(rows), np.int64), pa.int32())],
                names=["vec_id", "v", "norm", "far", "cell"])
    return tabled


def _sampled(vectors: DataFrame, rows: int) -> np.ndarray:
    """About ``rows`` quantised vectors, chosen by a hash of their id and components."""
    total = vectors.count()
    picked = thinned(vectors, F.xxhash64("vec_id", "vector"), rows, total).toArrow()["vector"].combine_chunks()
    return matrix(quantised(picked.filter(pa.array(usable(picked)))))


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row per usable vector: ``row`` (a number of its own), ``chunk``, integers ``v``, distances ``far``; written."""
    plain = in_arrow(vectors, _tabled(pivots), TABLE).withColumn(
        "near", F.coalesce(F.element_at("far", F.col("cell") + 1), F.lit(0)))
    stored = materialise(plain.withColumn("row", F.monotonically_increasing_id()), "pivots")
    chunks = max(LEAST_CHUNKS, -(-stored.count() // CHUNK))
    return materialise(stored.repartitionByRange(chunks, "cell", "near", "row")
                       .withColumn("chunk", F.spark_partition_id()).drop("near", "cell"), "chunks")


def _floors(queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A score that k candidates other than the query reach for certain."""
    if len(sample) <= k:
        return np.full(len(queries), -MOST)
    scores = _scores(sample, queries)
    own = (queries.astype(float) ** 2).sum(axis=1).astype(np.int64)
    # the sample may hold the query itself once: one score as high as its own does not count
    best = -np.partition(-scores, k, axis=0)[:k + 1]
    best = -np.sort(-best, axis=0)
    holds_own = (best == own).any(axis=0)
    return np.where(holds_own, best[k], best[k - 1]).astype(float)


def _dealt(sample: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, norms: np.ndarray, k: int):
    """Sends every query to the chunks whose distances leave room for a score of its floor."""
    def dealt(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            queries, far = matrix(batch.column("v")), matrix(batch.column("far"))
            norm = batch.column("norm").to_numpy()
            floor = _floors(queries, sample, k)
            for at in range(0, batch.num_rows, QUERIES):
                part = slice(at, at + QUERIES)
                q = far[part][:, None, :].astype(float)
                gap = np.maximum(np.maximum(low[None] - q, q - high[None]) - SLACK * (q + high[None]), 0).max(axis=2, initial=0)
                room = (norm[part][:, None] + norms[None] - gap ** 2) / 2
                query, span = np.nonzero(room + SLACK * np.abs(room) + 1 >= floor[part][:, None])
                sizes = (last - first + 1)[span]
                chunk = np.repeat(first[span] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                query = np.repeat(query, sizes)
                piece = batch.slice(at, QUERIES).take(pa.array(query))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk, pa.int32()), *(piece.column(n) for n in ("vec_id", "row", "v", "norm", "far")),
                     pa.array(floor[part][query])], names=["chunk", "vec_id", "row", "v", "norm", "far", "floor"])
    return dealt


def _best(chunk: dict, batch: pa.RecordBatch, k: int, tally=None):
    """(query, candidate, score) of the at most k best candidates of every query, from its floor on."""
    queries, far = matrix(batch.column("v")), matrix(batch.column("far"))
    norm, floors = batch.column("norm").to_numpy(), batch.column("floor").to_numpy()
    own = batch.column("row").to_numpy()
    found = []
    for at in range(0, batch.num_rows, QUERIES):
        part = slice(at, at + QUERIES)
        bound = np.zeros((len(norm[part]), len(chunk["row"])), np.float32)
        for p in range(far.shape[1]):
            there, here = far[part, p][:, None], chunk["far"][p][None]
            np.maximum(bound, np.abs(there - here) - np.float32(SLACK) * (there + here), out=bound)
        room = (norm[part][:, None] + chunk["norm"][None] - bound.astype(float) ** 2) / 2
        room += SLACK * np.abs(room) + 1
        room[own[part][:, None] == chunk["row"][None]] = -np.inf
        for i in range(len(room)):
            query, floor = at + i, floors[at + i]
            order = np.flatnonzero(room[i] >= max(floor, -MOST))
            order = order[np.argsort(-room[i][order], kind="stable")]
            best, scores, seen, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST
            while seen < len(order) and room[i][order[seen]] >= floor:
                some = order[seen:seen + step]
                some = some[room[i][some] >= floor]
                best = np.concatenate((best, some))
                scores = np.concatenate((scores, _scores(chunk["v"][some], queries[query:query + 1])[:, 0]))
                first = np.lexsort((chunk["id"][best], chunk["no_id"][best], -scores))[:k]
                best, scores = best[first], scores[first]
                if len(scores) == k:
                    floor = max(floor, float(scores[-1]))
                seen, step = seen + step, step * 4
            if tally is not None:
                tally.append((min(seen, len(order)), len(chunk["row"])))
            found.append((np.full(len(best), query), best, scores))
    return [np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def _search(k: int):
    def search(batches):
        """Rows come by chunk, candidates (no floor) before queries."""
        held, chunk, number = [], None, None
        for batch in batches:
            numbers = batch.column("chunk").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]))
            for start, stop in zip(edges[:-1], edges[1:]):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                if numbers[start] != number:
                    held, chunk, number = [], None, numbers[start]
                asks = piece.column("floor").is_valid().to_numpy(zero_copy_only=False)
                split = int((~asks).sum())
                if split:
                    held.append(piece.slice(0, split))
                piece = piece.slice(split)
                if not piece.num_rows or not held:
                    continue
                if chunk is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    column = lambda name: table[name].combine_chunks()
                    chunk = {"v": matrix(column("v")), "far": matrix(column("far")).T.copy(), "row": column("row").to_numpy(),
                             "norm": column("norm").to_numpy(), "id": column("vec_id").fill_null(0).to_numpy(),
                             "no_id": column("vec_id").is_null().to_numpy(zero_copy_only=False), "ids": column("vec_id")}
                    if not chunk["v"].size or np.abs(chunk["v"]).max() < 2 ** 31:
                        chunk["v"] = chunk["v"].astype(np.int32)
                    held = [None]
                query, best, scores = _best(chunk, piece, k)
                at = pa.array(query)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row").take(at), piece.column("vec_id").take(at), chunk["ids"].take(pa.array(best)),
                     pa.array(scores, pa.int64())], names=["row", "query_id", "vec_id", "score"])
    return search


def _ranges(table: DataFrame, pivots: int):
    """First and last chunk, least and greatest distances and greatest norm of at most ``RANGES`` runs of chunks."""
    chunks = table.agg(F.max("chunk")).first()[0]
    span = -(-((chunks or 0) + 1) // RANGES)
    got = table.groupBy(F.floor(F.col("chunk") / span)).agg(
        F.min("chunk").alias("first"), F.max("chunk").alias("last"), F.max("norm").alias("norm"),
        *[f(F.get("far", F.lit(p))).alias(f"{name}{p}") for p in range(pivots) for f, name in ((F.min, "low"), (F.max, "high"))]).toPandas()
    column = lambda name: got[[f"{name}{p}" for p in range(pivots)]].to_numpy(float)
    return got["first"].to_numpy(np.int64), got["last"].to_numpy(np.int64), column("low"), column("high"), got["norm"].to_numpy(float)


def top_k(vectors: DataFrame, k=5, every=50, vec_id="vec_id", vector="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every vector whose id is divisible by ``every``."""
    plain = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    sample = _sampled(plain, SAMPLE)
    pivots = far_apart(sample, PIVOTS)
    table = pivot_table(plain, pivots)
    dealt = in_arrow(table.filter(F.col("vec_id") % every == 0).select("vec_id", "row", "v", "norm", "far"),
                     _dealt(sample, *_ranges(table, len(pivots)), k), DEALT)
    rows = table.withColumn("floor", F.lit(None).cast("double")).select(dealt.columns).unionByName(dealt)
    met = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("floor").isNotNull())
    found = in_arrow(met, _search(k), "row long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
