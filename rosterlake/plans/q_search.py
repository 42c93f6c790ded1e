"""Listings, faceted and ranked search, paging."""

from pyspark.sql import functions as F

from ..operators import lifecycle, pages, ranking, search as S
from . import bindings as B
from .book import query
from .q_views import ROWS, registry_rows

_LEVEL = "CASE region_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.LEVEL_SCORE.items()) + " END"
_HEALTH = "CASE upper(health) WHEN 'HEALTHY' THEN 15 WHEN 'DEGRADED' THEN 7 ELSE 0 END"
_BASE = f"{_LEVEL} + region_score * 0.3 + quality_score * 0.2 + {_HEALTH}"
_Q = "src1"
_TEXT = f"""(contains(lower(name), '{_Q}') OR contains(lower(description), '{_Q}') OR len(list_filter(categories, lambda c: contains(lower(c), '{_Q}'))) > 0
  OR len(list_filter(tools, lambda t: contains(lower(t.name), '{_Q}') OR contains(lower(t.description), '{_Q}'))) > 0 OR contains(lower(ds_name), '{_Q}'))"""
_CAP = f"""(len(list_filter(tools, lambda t: contains(lower(t.name || ' ' || t.description), '{_Q}'))) + CASE WHEN contains(lower(ds_name || ' ' || ds_url), '{_Q}') THEN 1 ELSE 0 END)::DOUBLE
  / (len(tools) + 1)"""


@query("entity_listing", f"""WITH {ROWS}, f AS (SELECT * FROM registry WHERE region_level >= 'T1' AND security_status = 'CLEAN' AND quality_score >= 20),
p AS (SELECT id, quality_score FROM f ORDER BY quality_score DESC, id LIMIT 25 OFFSET 25)
SELECT id, quality_score, CAST(2 AS INTEGER) AS page, CAST(25 AS INTEGER) AS page_limit, (SELECT count(*) FROM f) AS total,
  CAST(greatest(ceil((SELECT count(*) FROM f) / 25.0), 1) AS BIGINT) AS total_pages FROM p""")
def entity_listing(spark, d):
    flt = S.EntityFilter(security_status="CLEAN", min_quality=20)
    return S.listing(registry_rows(spark, d), flt, page=2, limit=25).select(
        "id", "quality_score", "page", "page_limit", "total", "total_pages")


@query("entity_filters", f"""WITH {ROWS} SELECT 'all fields' AS filter, count(*) AS entities FROM registry WHERE entity_status = 'CANDIDATE' AND identity_status = 'CANDIDATE'
UNION ALL SELECT 'level', count(*) FROM registry WHERE region_level = 'T3'
UNION ALL SELECT 'min level', count(*) FROM registry WHERE region_level >= 'T4'
UNION ALL SELECT 'class', count(*) FROM registry WHERE primary_class = 'MCP_SERVER'
UNION ALL SELECT 'none', count(*) FROM registry""")
def entity_filters(spark, d):
    rows = registry_rows(spark, d)
    filters = {"all fields": S.EntityFilter(entity_status="CANDIDATE", identity_status="CANDIDATE"),
               "level": S.EntityFilter(region_level="T3"), "min level": S.EntityFilter(min_region_level="T4"),
               "class": S.EntityFilter(primary_class="MCP_SERVER"), "none": S.EntityFilter()}
    return S.filter_counts(rows, filters)


@query("text_listing", f"""WITH {ROWS} SELECT id FROM registry WHERE contains(lower(name), 'mit') OR contains(lower(description), 'mit') OR contains(lower(slug), 'mit')
  OR contains(lower(repo_url), 'mit') OR len(list_filter(tools, lambda t: contains(lower(t.name), 'mit'))) > 0""")
def text_listing(spark, d):
    return registry_rows(spark, d).filter(S.entity_text_match("Mit")).select("id")


@query("ranked_search", f"""WITH {ROWS}, s AS (SELECT id, round(CAST({_BASE} + ({_CAP}) * 15 AS DOUBLE), 6) AS score FROM registry WHERE {_TEXT})
SELECT * FROM s ORDER BY score DESC, id LIMIT 40 OFFSET 10""")
def ranked_search(spark, d):
    found = S.search(registry_rows(spark, d).withColumn("region_score", F.col("region_score")),
                     S.SearchQuery(text=_Q.upper(), limit=40, offset=10))
    return found.select("id", F.round("score", 6).alias("score"))


@query("faceted_search", f"""WITH {ROWS} SELECT id, round(CAST({_BASE} AS DOUBLE), 6) AS score FROM registry WHERE region_level = 'T3' AND quality_score >= 10
  AND upper(health) IN ('HEALTHY', 'DEGRADED') AND len(list_filter(categories, lambda c: lower(c) IN ('metro', 'gis', 'search'))) > 0
  AND len(list_filter(endpoints, lambda e: e.transport = 'http')) > 0""")
def faceted_search(spark, d):
    found = S.search(registry_rows(spark, d), S.SearchQuery(
        level="T3", min_score=10, health=("healthy", "degraded"), categories=("METRO", "gis", "search"), transports=("HTTP",)))
    return found.select("id", F.round("score", 6).alias("score"))


@query("official_search", f"WITH {ROWS} SELECT id FROM registry WHERE contains(trust_source, 'registry')")
def official_search(spark, d):
    return S.search(registry_rows(spark, d), S.SearchQuery(official=True)).select("id")


@query("capability_search", f"""WITH {ROWS}, s AS (SELECT id, round(CAST({_BASE} + ({_CAP}) * 15 AS DOUBLE), 6) AS score FROM registry WHERE {_TEXT})
SELECT * FROM s""")
def capability_search(spark, d):
    return S.search_by_capability(registry_rows(spark, d), _Q).select("id", F.round("score", 6).alias("score"))


_PAGE = """SELECT p_partkey, p_size, CAST({0} AS INTEGER) AS page, CAST({1} AS INTEGER) AS page_limit, (SELECT count(*) FROM part) AS total,
  CAST(ceil((SELECT count(*) FROM part) / {1}.0) AS BIGINT) AS total_pages FROM part ORDER BY p_size DESC, p_partkey LIMIT {1} OFFSET ({0} - 1) * {1}"""


@query("part_pages", _PAGE.format(1, 1000))
def part_pages(spark, d):
    """A page as long as it was asked for."""
    return ranking.page(B.table(spark, d, "part").select("p_partkey", "p_size"), ("-p_size", "p_partkey"), 1, 1000)


@query("part_pages_bounded", _PAGE.format(3, 200))
def part_pages_bounded(spark, d):
    """A page of 1000 under a service's largest page size."""
    return ranking.page(B.table(spark, d, "part").select("p_partkey", "p_size"), ("-p_size", "p_partkey"), 3, 1000, ranking.MAX_LIMIT)


@query("parts_per_source", """SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 5""")
def parts_per_source(spark, d):
    return lifecycle.cap_per_source(B.table(spark, d, "part"), 5, "p_brand", ("-p_retailprice", "p_partkey")) \
                    .select("p_brand", "p_partkey")


@query("one_source", """SELECT p_partkey FROM part WHERE p_brand = 'Brand#3' ORDER BY p_partkey LIMIT 20""")
def one_source(spark, d):
    return lifecycle.cap_per_source(B.table(spark, d, "part"), 20, "p_brand", ("p_partkey",), only="Brand#3").select("p_partkey")


@query("positions_per_segment", """SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer""")
def positions_per_segment(spark, d):
    return ranking.positions(B.table(spark, d, "customer"), "c_mktsegment", ("-c_acctbal", "c_custkey"),
                             columns=["c_mktsegment", "c_custkey", "c_acctbal"]).drop("c_acctbal")


@query("facet_order", "SELECT event_type, count(*) AS entries FROM events GROUP BY event_type ORDER BY entries DESC, event_type")
def facet_order(spark, d):
    return ranking.counts_desc(B.table(spark, d, "events"), "event_type")


_ORDER = ("-o_totalprice", "o_orderkey")


def _order_index(spark, d):
    return pages.order_index(B.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), _ORDER, part_rows=2000)


@query("indexed_page", """SELECT o_orderkey, o_totalprice, 29 AS page, 97 AS page_limit, (SELECT count(*) FROM orders) AS total,
  CAST(ceil((SELECT count(*) FROM orders) / 97) AS BIGINT) AS total_pages FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 97 OFFSET 2716""")
def indexed_page(spark, d):
    """A deep page that reads the parts it falls into."""
    return pages.page(_order_index(spark, d), 29, 97)


@query("rows_after_key", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 7)
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 2500""")
def rows_after_key(spark, d):
    """The rows behind a key, across parts."""
    return pages.after(_order_index(spark, d), (200000.0, 7), 2500)
