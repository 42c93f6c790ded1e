"""State machines, promotion, incremental selection, validation."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import explode_rows
from ..rules import vocab
from .classify import first_true
from .ranking import first_n_per_group


def allowed(before: Column, after: Column, moves: dict) -> Column:
    """Whether a state may follow another; unknown states allow nothing."""
    return F.coalesce(first_true(
        [(before == b, after.isin(*a)) for b, a in moves.items()], F.lit(False)), F.lit(False))


def check_moves(df: DataFrame, before: str, after: str, moves: dict, out="allowed") -> DataFrame:
    return df.withColumn(out, allowed(F.col(before), F.col(after), moves))


def rejected_moves(df: DataFrame, before: str, after: str, moves: dict) -> DataFrame:
    """Counts of forbidden (before, after) pairs."""
    return (df.filter(~allowed(F.col(before), F.col(after), moves))
            .groupBy(before, after).agg(F.count("*").alias("rows")))


def promote(status: Column, static_checked: Column, runtime: Column, security: Column) -> Column:
    """One step up the identity ladder when its condition holds."""
    passed = F.coalesce(runtime == "PASSED", F.lit(False))
    return (F.when((status == "CANDIDATE") & static_checked, "STATIC_VERIFIED")
            .when((status == "STATIC_VERIFIED") & passed, "RUNTIME_VERIFIED")
            .when((status == "RUNTIME_VERIFIED") & static_checked & passed & (security != "BLOCKED"), "VERIFIED")
            .otherwise(status))


def promotion_gate(status: Column, static_checked: Column, runtime: Column, security: Column) -> Column:
    return (static_checked & F.coalesce(runtime == "PASSED", F.lit(False)) & (security != "BLOCKED")
            & status.isin("STATIC_VERIFIED", "RUNTIME_VERIFIED", "VERIFIED"))


def promote_gated(status: Column, static_checked: Column, runtime: Column, security: Column) -> Column:
    return F.when(promotion_gate(status, static_checked, runtime, security),
                  promote(status, static_checked, runtime, security)).otherwise(status)


def changed_since(pushed_at: Column, last_seen: Column) -> Column:
    """Pushed after last seen; an unknown time on either side means re-fetch."""
    return F.coalesce(pushed_at > last_seen, F.lit(True))


def due(source: Column, last_run: Column, as_of: Column, hours=vocab.CRAWL_INTERVAL_HOURS,
        default=vocab.DEFAULT_INTERVAL_HOURS) -> Column:
    """Interval of the source has passed; never run counts as due."""
    table = F.create_map(*[F.lit(x) for kv in hours.items() for x in kv])
    wait = F.coalesce(F.try_element_at(table, source), F.lit(default))
    elapsed = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_run.cast("timestamp"))
    return F.coalesce(elapsed >= wait.cast("long") * 3_600_000_000, F.lit(True))


def next_full_run(as_of: Column) -> Column:
    """Next Sunday 02:00 after ``as_of``."""
    two = F.make_interval(hours=F.lit(2))
    today = F.date_trunc("DAY", as_of)
    ahead = (F.lit(8) - F.dayofweek(as_of)) % 7
    slot = F.date_add(today, ahead).cast("timestamp") + two
    return F.when(slot > as_of, slot).otherwise(F.date_add(today, ahead + 7).cast("timestamp") + two)


def eligibility(status: Column, endpoints: Column) -> Column:
    """struct<eligible, reason, url, transport> for runtime verification."""
    runtime = F.get(F.filter(endpoints, lambda e: e["type"] == "MCP_RUNTIME_ENDPOINT"), F.lit(0))
    low = F.lower(runtime["url"])
    transport = (F.when(F.contains(low, F.lit("stdio")), "stdio")
                 .when(F.contains(low, F.lit("sse")), "sse")
                 .when(low.rlike("streamable-http|https?://"), "streamable-http")
                 .otherwise("stdio"))
    reason = (F.when(status.isNull() | (status != "STATIC_VERIFIED"), "static_verified_required")
              .when(runtime.isNull(), "runtime_endpoint_required").otherwise("eligible"))
    ok = reason == "eligible"
    return F.struct(ok.alias("eligible"), reason.alias("reason"),
                    F.when(ok, runtime["url"]).alias("url"), F.when(ok, transport).alias("transport"))


# column -> vocabulary, for validation
VOCABULARIES = {
    "primary_class": vocab.PRIMARY_CLASSES,
    "entity_status": vocab.ENTITY_STATUSES,
    "identity_status": vocab.IDENTITY_STATUSES,
    "security_status": vocab.SECURITY_STATUSES,
    "region_level": vocab.REGION_LEVELS,
    "quality_grade": vocab.GRADES,
}


def violations(df: DataFrame, key="id", vocabularies=VOCABULARIES, ranges=None, required=("name", "slug")) -> DataFrame:
    """Long (key, column, problem, value) table; valid rows contribute nothing."""
    ranges = {"quality_score": (0, 100)} if ranges is None else ranges

    def problem(column, kind, bad):
        return F.when(F.coalesce(bad, F.lit(True)), F.struct(
            F.lit(column).alias("column"), F.lit(kind).alias("problem"),
            F.col(column).cast("string").alias("value")))

    checks = [problem(c, "required", F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
              for c in (key, *required)]
    checks += [problem(c, "enum", ~F.col(c).isin(*v)) for c, v in vocabularies.items() if c in df.columns]
    checks += [problem(c, "range", ~F.col(c).between(lo, hi)) for c, (lo, hi) in ranges.items()]
    return explode_rows(df, key, F.array_compact(F.array(*checks)), "v").select(key, "v.*")


def cap_per_source(df: DataFrame, n: int, source="source", order=("id",), only: str = None) -> DataFrame:
    """At most n candidates per source, optionally of one source."""
    if only is not None:
        df = df.filter(F.col(source) == only)
    return first_n_per_group(df, source, order, n) if n > 0 else df


def unprocessed(df: DataFrame, done: DataFrame, key="id") -> DataFrame:
    """Rows whose key is not in the checkpoint table."""
    return df.join(done.select(key).distinct(), key, "left_anti")
