"""Evidence arrays, long evidence tables and the confidence formulas over them."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..rules import classes

def item(kind, source, rule, matched, confidence, score=0.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(kind).alias("type"), as_col(source).alias("source"), as_col(rule).alias("rule"),
        as_col(matched).alias("matched"), F.lit(float(score)).alias("score"),
        F.lit(float(confidence)).alias("confidence"))


def mean_confidence(evidence: Column, empty=0.1) -> Column:
    total = F.aggregate(evidence, F.lit(0.0), lambda acc, e: acc + e["confidence"])
    return F.when(F.size(evidence) == 0, F.lit(empty)) \
            .otherwise(F.least(total / F.size(evidence), F.lit(1.0)))


def _weighted(evidence: Column, weight) -> tuple:
    num = F.aggregate(evidence, F.lit(0.0), lambda acc, e: acc + e["confidence"] * weight(e))
    den = F.aggregate(evidence, F.lit(0.0), lambda acc, e: acc + weight(e))
    return num, den


def score_weighted_confidence(evidence: Column) -> Column:
    """Mean weighted by evidence score; negative evidence weighs 5; in [0.1, 1]."""
    num, den = _weighted(
        evidence, lambda e: F.when(e["score"] < 0, F.lit(5.0)).otherwise(e["score"]))
    return F.when(den > 0, F.least(F.greatest(num / den, F.lit(0.1)), F.lit(1.0))) \
            .otherwise(F.lit(0.1))


def type_weighted_confidence(evidence: Column) -> Column:
    """Mean weighted by evidence type; 0 without evidence."""
    table = F.create_map(*[F.lit(x) for kv in classes.TYPE_WEIGHTS.items() for x in kv])
    num, den = _weighted(evidence, lambda e: F.coalesce(
        F.try_element_at(table, e["type"]), F.lit(classes.TYPE_WEIGHT_DEFAULT)))
    return F.when(den > 0, F.least(num / den, F.lit(1.0))).otherwise(F.lit(0.0))


def rule_weighted_confidence(evidence: Column, aliases=classes.IDENTITY_RULE_ALIASES) -> Column:
    """Sum of weight x confidence over known rules, capped at 100."""
    weights = {**classes.IDENTITY_WEIGHTS,
               **{a: classes.IDENTITY_WEIGHTS[n] for a, n in (aliases or {}).items()}}
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    total = F.aggregate(evidence, F.lit(0.0), lambda acc, e: acc + e["confidence"] * F.coalesce(
        F.try_element_at(table, e["rule"]), F.lit(0.0)))
    return F.least(total, F.lit(100.0))


def has_rule_outside(evidence: Column, rules) -> Column:
    return F.exists(evidence, lambda e: ~e["rule"].isin(*rules))


def is_strong(evidence: Column) -> Column:
    return has_rule_outside(evidence, classes.WEAK_RULES)


def is_bridge(evidence: Column) -> Column:
    return has_rule_outside(evidence, classes.BRIDGE_RULES)


def has_runtime(evidence: Column) -> Column:
    return F.exists(evidence, lambda e: e["rule"].isin(*classes.RUNTIME_RULES))


def by_type(evidence: Column, kind: str) -> Column:
    return F.filter(evidence, lambda e: e["type"] == kind)


# --- long form ---------------------------------------------------------------

def typed_rows(df: DataFrame, key: str, kind: str, matched: Column, confidence: Column, as_of: Column,
               location: Column = None, snippet: Column = None, rule: Column = None,
               seen_at: Column = None, snippet_limit: int = None) -> DataFrame:
    """Evidence rows of one kind; source and rule are fixed per kind.

    Snippets are whole unless ``snippet_limit`` cuts them (``classes.SNIPPET_LIMIT`` is customary for display).
    """
    source, fixed_rule = classes.EVIDENCE_KINDS[kind]
    text = lambda c: F.lit("") if c is None else c
    return df.select(
        key, F.lit(kind).alias("type"), F.lit(source).alias("source"),
        text(location).alias("location"), matched.alias("matched"), T.content_key(matched).alias("content_hash"),
        T.truncate(text(snippet), snippet_limit, "").alias("snippet"),
        (rule if fixed_rule is None else F.lit(fixed_rule)).alias("rule"),
        confidence.cast("double").alias("confidence"),
        (as_of if seen_at is None else F.coalesce(seen_at, as_of)).alias("seen_at"))


def long_flags(evidence: DataFrame, key: str) -> DataFrame:
    """Strong / bridge / runtime flags and the three confidences per key.

    Plain sums and maxima: combined map-side, so a key that owns a large share
    of the evidence costs no more than any other.
    """
    rule, conf = F.col("rule"), F.col("confidence")
    type_w = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for kv in classes.TYPE_WEIGHTS.items() for x in kv]), F.col("type")),
        F.lit(classes.TYPE_WEIGHT_DEFAULT))
    rule_w = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for k, v in classes.IDENTITY_WEIGHTS.items() for x in (k, float(v))]),
        rule), F.lit(0.0))
    return evidence.groupBy(key).agg(
        F.bool_or(~rule.isin(*classes.WEAK_RULES)).alias("strong"),
        F.bool_or(~rule.isin(*classes.BRIDGE_RULES)).alias("bridge"),
        F.bool_or(rule.isin(*classes.RUNTIME_RULES)).alias("runtime"),
        F.least(F.avg(conf), F.lit(1.0)).alias("mean_confidence"),
        F.least(F.sum(conf * type_w) / F.sum(type_w), F.lit(1.0)).alias("type_confidence"),
        F.least(F.sum(conf * rule_w), F.lit(100.0)).alias("rule_confidence"))
