"""Pages from an order index against slices of the sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import pages, ranking

SPEC = ("-quality", "name", "id")


def made(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, 0.5, 0.5, 0.5, rng.random()]), rng.choice([None, "a", "b", "ß", ""]), k) for k in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode(), r[2]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "quality double, name string, id long")


@pytest.fixture(scope="module")
def listing(spark):
    rows = made(1500)
    return in_order(rows), pages.order_index(frame(spark, rows), SPEC, part_rows=100)


def plain(df):
    return [tuple(r)[:3] for r in df.collect()]


@pytest.mark.parametrize("no, limit", [(1, 10), (7, 33), (46, 33), (2, 1000), (151, 10), (150, 10), (1, 5000)])
def test_pages(listing, no, limit):
    rows, index = listing
    got = pages.page(index, no, limit).collect()
    assert [tuple(r)[:3] for r in got] == rows[(no - 1) * limit:no * limit]
    assert all((r.page, r.page_limit, r.total, r.total_pages) == (no, limit, 1500, -(-1500 // limit)) for r in got)


def test_a_page_reads_two_parts_at_most(listing, monkeypatch):
    _, index = listing
    asked, plain_page = [], pages._page
    monkeypatch.setattr(pages, "_page", lambda index, parts, *a: asked.append(parts) or plain_page(index, parts, *a))
    assert len(index.ends) >= 12 and index.total == 1500
    sizes = [b - a for a, b in zip([0, *index.ends], index.ends)]
    assert max(sizes) < 3 * 100          # ties of the first column do not make a part larger
    for no in (1, 40, 75):
        text = pages.page(index, no, 20)._jdf.queryExecution().toString()
        assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text
    assert [len(parts) <= 2 for parts in asked] == [True] * 3 and asked[1].start >= 6


@pytest.mark.parametrize("seed", range(3))
def test_rows_after_a_key(listing, seed):
    rows, index = listing
    at = random.Random(seed).randrange(len(rows))
    assert plain(pages.after(index, rows[at], 130)) == rows[at + 1:at + 131]


def test_keys_that_no_row_has(listing):
    rows, index = listing
    for key in ((0.5, "az", 3), (2.0, None, 0), (0.25, "zz", -1)):
        want = [r for r in rows if in_order([r, key])[0] == key and r != key][:40]
        assert plain(pages.after(index, key, 40)) == want
    assert plain(pages.after(index, (None, "ß", 10 ** 9), 5)) == []


def test_small_listings(spark):
    empty = pages.order_index(frame(spark, []), SPEC)
    assert pages.page(empty).count() == 0 and pages.after(empty, (1.0, "a", 1)).count() == 0 and empty.total == 0
    one = pages.order_index(frame(spark, [(None, None, 1)]).withColumn("part", F.lit("z")), SPEC)
    got = pages.page(one, 1, 10)
    assert got.columns[:4] == ["quality", "name", "id", "part"] and got.count() == 1 and got.first()["total_pages"] == 1
    assert pages.page(one, 3, 10).count() == 0


def test_same_as_paging_by_offset(spark):
    df = frame(spark, made(300, seed=3))
    index = pages.order_index(df, SPEC, part_rows=40)
    for no in (1, 5, 12):
        assert pages.page(index, no, 25).collect() == ranking.page(df, SPEC, no, 25).collect()
