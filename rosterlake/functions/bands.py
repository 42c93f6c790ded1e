"""Score and time bands.  Time bands always take ``as_of``: results must not
depend on when an executor happens to run."""

from pyspark.sql import Column, functions as F

from ..rules import vocab


def _floor_ladder(score: Column, bands, otherwise) -> Column:
    expr = F.when(score >= bands[0][0], bands[0][1])
    for floor, label in bands[1:]:
        expr = expr.when(score >= floor, label)
    return expr.otherwise(otherwise)


def region_level(score: Column) -> Column:
    return _floor_ladder(score, vocab.REGION_BANDS, "T0")


def ai_level(score: Column) -> Column:
    return _floor_ladder(score, vocab.AI_BANDS, "A0")


def grade(score: Column) -> Column:
    return _floor_ladder(score, vocab.GRADE_BANDS, "F")


def age_days(when: Column, as_of: Column) -> Column:
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(when.cast("timestamp"))
    return seconds / F.lit(86_400_000_000.0)


def _age_ladder(when, as_of, bands, oldest, missing) -> Column:
    days = age_days(when, as_of)
    expr = F.when(when.isNull(), missing)
    for limit, label in bands:
        expr = expr.when(days < limit, label)
    return expr.otherwise(oldest)


def activity(pushed_at: Column, as_of: Column, archived: Column = None) -> Column:
    status = _age_ladder(pushed_at, as_of, vocab.ACTIVITY_BANDS, "DORMANT", "UNKNOWN")
    if archived is None:
        return status
    return F.when(F.coalesce(archived, F.lit(False)), "ARCHIVED").otherwise(status)


def maintenance_points(pushed_at: Column, as_of: Column) -> Column:
    return _age_ladder(pushed_at, as_of, vocab.MAINTENANCE_BANDS, 3, 0)


def at_least_level(level: Column, floor="T1") -> Column:
    """Levels order lexically, so a floor is a string comparison the scan can use."""
    return (level >= floor) & (level <= "T5")


_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})\z"


def parse_rfc3339(text: Column) -> Column:
    """Timestamp, or NULL for anything that is not a full RFC 3339 time."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(text))


def run_id(when: Column) -> Column:
    return F.date_format(when, "yyyyMMdd'T'HHmmss'Z'")
