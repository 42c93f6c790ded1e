"""Every registered query against its oracle SQL."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare
from rosterlake.plans import book

OWN, ORACLES = book.load()
QUERIES = {name: fn for name, fn in entry.queries().items() if name in OWN}
# checked against brute force on small fixtures instead
ROWS_ONLY = set()


def test_every_query_is_checked():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    verdict, _, ok = compare(spark, duck, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert ok, verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
