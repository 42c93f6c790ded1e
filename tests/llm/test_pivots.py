"""Exact top-k search against scores of all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from rosterlake.llm import pivots
from rosterlake.llm.book import load

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    plain = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(plain):
        if q is None or q % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), i is None, i) for j, (i, w) in enumerate(plain) if j != at]
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def vectors(n, dim=12, seed=1, groups=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(i, [c + rng.gauss(0, 0.3) for c in centres[i % groups]]) for i in range(n)]


def test_equals_all_pairs(spark):
    rows = vectors(900)
    assert result(pivots.top_k(frame(spark, rows).repartition(4), every=10)) == brute(rows, every=10)


def test_small_sample_and_few_pivots(spark, monkeypatch):
    for name, value in (("SAMPLE", 40), ("PIVOTS", 3), ("CHUNK", 30), ("QUERIES", 3), ("FIRST", 2), ("RANGES", 4)):
        monkeypatch.setattr(pivots, name, value)
    rows = vectors(400, seed=2)
    assert result(pivots.top_k(frame(spark, rows).repartition(3), every=20)) == brute(rows, every=20)


def test_copies_ties_and_repeated_ids(spark):
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(300)] + [(50, [0.5, -0.25, 1.0])] * 3 + [(7, [1.0, 1.0, 1.0])] * 2
    assert result(pivots.top_k(frame(spark, rows).repartition(5))) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [None, 1.0]), (250, []), (300, [1.0]),
            (None, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, [-1.0, 0.001]), (-50, [0.0, -0.0])]
    assert result(pivots.top_k(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, None)], [(0, [1.0]), (3, [-2.0])]],
                         ids=["empty", "alone", "no query", "null", "fewer than k"])
def test_small(spark, rows):
    assert result(pivots.top_k(frame(spark, rows))) == brute(rows)


def test_large_components(spark):
    rows = [(i, [float(2 ** 21 + i), -float(2 ** 20) + i, 3.0]) for i in range(120)]
    assert result(pivots.top_k(frame(spark, rows))) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        pivots.top_k(frame(spark, [(0, [3e38, 3e38]), (1, [3e38, 3e38])])).collect()


def test_clashing_columns(spark):
    rows = vectors(120, seed=3)
    names = ["v", "far", "norm", "chunk", "row", "floor", "cell", "vector", "rank", "score", "query_id"]
    wide = frame(spark, rows).selectExpr("*", *[f"'z' AS `{x}`" for x in names])
    assert result(pivots.top_k(wide)) == brute(rows)


def test_bounds_leave_out_candidates():
    """Well separated groups: most candidates are never evaluated, and the best ones always are."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (20, 8))
    rows = (centres[rng.integers(0, 20, 3000)] + rng.normal(0, 4, (3000, 8))).astype(np.int64)
    chosen = pivots.far_apart(rows, 20)
    far = pivots.distances(rows, chosen).astype(np.float32)
    norm = (rows.astype(float) ** 2).sum(axis=1)
    chunk = {"v": rows, "far": far.T.copy(), "row": np.arange(3000), "norm": norm, "id": np.arange(3000), "no_id": np.zeros(3000, bool)}
    asked = np.arange(0, 3000, 100)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(asked), pivots.as_lists(rows[asked], pa.int64()), pivots.as_lists(far[asked], pa.float32()),
         pa.array(norm[asked]), pa.array(np.full(len(asked), -pivots.MOST))], names=["row", "v", "far", "norm", "floor"])
    tally = []
    query, best, scores = pivots._best(chunk, batch, 5, tally)
    assert sum(a for a, _ in tally) < 0.4 * sum(b for _, b in tally)
    for i, q in enumerate(asked):
        plain = rows @ rows[q]
        plain[q] = np.iinfo(np.int64).min
        assert sorted(scores[query == i].tolist()) == sorted(plain.tolist())[-5:]


def test_query_and_its_sql_on_odd_rows(spark, stored, tmp_path):
    import duckdb
    from check_oracles import compare
    rows = vectors(160, dim=5, seed=6) + [(200, None), (250, [float("nan")] * 5), (51, [0.1] * 5), (0, [0.1] * 5)]
    folder = stored(embeddings=frame(spark, rows))
    queries, sql = load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    verdict, _, ok = compare(spark, con, folder, "op11_exact_top_k", queries["op11_exact_top_k"], sql["op11_exact_top_k"])
    assert ok, verdict
