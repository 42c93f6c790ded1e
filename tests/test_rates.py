"""Request windows of hot keys: row-bounded blocks, composed functions, places without a window per instant."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.operators import rates

WIDTH = 60_000_000


def brute(us, width):
    """(opening time, place) of sorted times of one key."""
    opened, places, at = np.empty(len(us), np.int64), np.empty(len(us), np.int64), 0
    while at < len(us):
        stop = int(np.searchsorted(us, us[at] + width, side="right"))
        opened[at:stop] = us[at]
        places[at:stop] = np.arange(1, stop - at + 1)
        at = stop
    return opened, places


def log(spark, us, key="all"):
    pdf = [(int(i), key, int(t)) for i, t in enumerate(us)]
    return spark.createDataFrame(pdf, "id long, key string, us long").select("id", "key", F.timestamp_micros("us").alias("ts"), "us")


def checked(spark, us, seconds, blocks, monkeypatch=None):
    us = np.sort(np.asarray(us, np.int64))
    df = log(spark, us)
    got = rates.request_verdicts(df, "key", "ts", "id", 5, seconds, blocks).select("id", "place").collect()
    opened, places = brute(us, int(seconds * 1_000_000))
    assert [p for _, p in sorted(map(tuple, got))] == places.tolist()
    windows = {(r["opened_at"], r["requests"]) for r in rates.key_opened_windows(df, "key", "ts", 5, seconds, blocks)
               .select(F.unix_micros("opened_at").alias("opened_at"), "requests").collect()}
    starts, counts = np.unique(opened, return_counts=True)
    assert windows == set(zip(starts.tolist(), counts.tolist()))


def test_one_key_in_one_hour(spark):
    """Microsecond steps all over one hour: windows about as long as blocks."""
    rng = np.random.default_rng(1)
    checked(spark, rng.integers(0, 3_600_000_000, 12_000), 60, 40)


@pytest.mark.parametrize("seconds", [0.001, 7200])
def test_windows_far_shorter_and_far_longer_than_blocks(spark, seconds):
    checked(spark, np.random.default_rng(2).integers(0, 3_600_000_000, 6_000), seconds, 16)


def test_burst_before_sparse_requests(spark):
    """Windows of many crowded blocks end between two late requests."""
    us = np.concatenate((np.arange(4_000) * 10, 40_000_000 + np.arange(300) * 7_000_000, 5_000_000_000 + np.arange(3_000)))
    checked(spark, us, 60, 24)


def test_one_instant(spark):
    checked(spark, np.full(5_000, 1_000_000), 60, 12)


def test_blocks_hold_equal_shares(spark):
    """Neither a hot key nor one crowded microsecond makes a block larger than the others."""
    df = spark.range(30_000).select(F.col("id"), F.lit("all").alias("k"), F.when(F.col("id") < 20_000, F.lit(5)).otherwise(F.col("id")).alias("us"),
                                    F.lit(1).cast("long").alias("w"))
    stored = rates._in_blocks(df.withColumn("n", F.monotonically_increasing_id()), ("id", "n"), 16)
    sizes = [r["count"] for r in stored.groupBy("b").count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) >= 14 and max(sizes) < 2 * 30_000 / 16


def test_no_group_of_a_level_outgrows_two_blocks(spark, monkeypatch):
    """What one task composes is the entries of one block and the function of another."""
    plain = rates._land

    def land(key, pdf):
        out = plain(key, pdf)
        return out.assign(exit=len(pdf))
    us = np.sort(np.random.default_rng(3).integers(0, 3_600_000_000, 8_000))
    df = log(spark, us).select(F.lit("all").alias("k"), "us", F.lit(1).cast("long").alias("w"))
    stored = rates._in_blocks(df.groupBy("k", "us").agg(F.sum("w").alias("w")), (), 32)
    leaves = rates.materialise(rates._by_block(stored).applyInArrow(rates._leaf(WIDTH), rates._LEAF), "windows")
    chains = rates._Chains(leaves.filter("kind = 0").select("b", "k", "cand", "exit", "used").toPandas())
    level0 = leaves.filter("kind = 1").select("b", "cand", "exit", "used")
    most = stored.groupBy("b").count().agg(F.max("count")).first()[0]
    told = level0.mapInPandas(rates._further(chains, 0), rates._FUNCTION + ", to int").filter("to >= 0")
    assert told.groupBy("b", "to").count().agg(F.max("count")).first()[0] <= most
    assert level0.groupBy("b").count().agg(F.max("count")).first()[0] <= most
    monkeypatch.setattr(rates, "_land", land)
    level1 = rates._composed(level0, chains)[1].join(told.select("b", "cand"), ["b", "cand"])
    seen = [r["exit"] for r in level1.select("exit").distinct().collect()]
    assert seen and max(seen) <= 2 * most


def test_many_keys_and_one_hot(spark):
    rng = np.random.default_rng(4)
    keys = np.where(rng.random(6_000) < 0.4, 0, rng.integers(1, 400, 6_000))
    us = rng.integers(0, 900_000_000, 6_000)
    df = spark.createDataFrame([(int(i), f"k{k}", int(t)) for i, (k, t) in enumerate(zip(keys, us))], "id long, key string, us long")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    got = dict(map(tuple, rates.request_verdicts(df, "key", "ts", "id", 3, 60, 10).select("id", "place").collect()))
    for k in np.unique(keys):
        mine = np.flatnonzero(keys == k)
        mine = mine[np.lexsort((mine, us[mine]))]
        assert [got[int(i)] for i in mine] == brute(us[mine], WIDTH)[1].tolist()


def test_repeated_rows_and_clashing_columns(spark):
    df = log(spark, [0, 0, 0, 10]).withColumns({c: F.lit("z") for c in ("k", "b", "n", "w", "row")}).drop("us")
    got = rates.request_verdicts(df.unionByName(df), "key", "ts", "id", 2, 60, 3)
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 9))
    assert got.columns == [*df.columns, "place", "allowed"]
