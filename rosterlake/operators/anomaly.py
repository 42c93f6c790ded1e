"""Text and account anomalies, folded into one risk level per row."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands, chars, regex
from ..functions.arrays import computed_once, explode_rows
from ..rules import patterns


def _signal(kind, severity, evidence, confidence) -> Column:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(F.lit(kind).alias("type"), sev.alias("severity"),
                    evidence.cast("string").alias("evidence"), F.lit(confidence).alias("confidence"))


def fixed(x: Column, digits: int) -> Column:
    """Plain decimal text, no grouping."""
    return F.round(x, digits).cast(f"decimal(38,{digits})").cast("string")


def text_signals(text: str, entropy: str, limits: dict) -> list:
    """One column per signal, NULL where it does not fire; the evidence of a rule is its whole first match."""
    t, ent = F.col(text), F.col(entropy)
    conf = patterns.SIGNAL_CONFIDENCE
    size = F.octet_length(t)
    unstructured = ~chars.has_markdown_structure(t)
    folded = regex.fold_case(t)
    ratio, mass = chars.non_text_ratio(t), chars.base64_mass(t)

    first_match = lambda r: regex.first(t, r.pattern)
    code = []
    for r in patterns.ANOMALY_RULES:
        gate = regex.contains_any(folded, r.needles) if r.needles else F.lit(True)
        code.append(F.when(gate & regex.matches(t, r.pattern), _signal(
            r.family, r.severity, first_match(r), patterns.ANOMALY_FAMILIES[r.family].confidence)))
    return [
        F.when((ent > limits["entropy"]) & unstructured, _signal(
            "readme_entropy", "HIGH", F.concat(F.lit("entropy="), fixed(ent, 2), F.lit(", length="), size),
            conf["readme_entropy"])),
        F.when((size > limits["size_bytes"]) & unstructured, _signal(
            "readme_size_anomaly", "MEDIUM", F.concat(F.lit("size="), size, F.lit(" bytes")),
            conf["readme_size_anomaly"])),
        *code,
        F.when(mass > patterns.BASE64_TOTAL_FLOOR, _signal(
            "obfuscation_base64", "MEDIUM", F.concat(F.lit("total_base64_chars="), mass),
            conf["obfuscation_base64"])),
        F.when(ratio > limits["non_text_ratio"], _signal(
            "non_text_ratio", "HIGH", F.concat(F.lit("ratio="), fixed(ratio, 3)), conf["non_text_ratio"])),
    ]


def account_signal(created_at: Column, followers: Column, bio: Column, repos: Column, as_of: Column,
                   limits=None) -> Column:
    """NULL unless at least two account properties are unusual.

    A missing value is unknown, not unusual.
    """
    limits = limits or patterns.ANOMALY_DEFAULTS
    odd = F.array_compact(F.array(
        F.when(bands.age_days(created_at, as_of) < limits["account_age_days"], "account_age"),
        F.when(followers <= limits["min_followers"], "followers"),
        F.when(bio == "", "no_bio"),
        F.when(repos < limits["min_repos"], "repos")))
    severity = F.when(F.size(odd) == 2, "MEDIUM").when(F.size(odd) == 3, "HIGH").otherwise("CRITICAL")
    return F.when(F.size(odd) >= 2, _signal(
        "account_anomaly", severity, F.array_join(odd, "; "), patterns.SIGNAL_CONFIDENCE["account_anomaly"]))


def risk(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return (F.when((critical > 0) | (high >= 2), "CRITICAL")
            .when((high > 0) | (medium >= 3), "HIGH")
            .when((medium > 0) | (low >= 3), "MEDIUM")
            .otherwise("LOW"))


def risk_of(signals: Column) -> Column:
    """struct<risk_level, confidence> of a signal array."""
    n = lambda sev: F.size(F.filter(signals, lambda s: s["severity"] == sev))
    conf = F.aggregate(signals, F.lit(0.0), lambda acc, s: acc + s["confidence"])
    return F.struct(
        risk(n("CRITICAL"), n("HIGH"), n("MEDIUM"), n("LOW")).alias("risk_level"),
        F.when(F.size(signals) == 0, 1.0).otherwise(conf / F.size(signals)).alias("confidence"))


def detect(df: DataFrame, text: str, out="anomaly", account: Column = None, limits=None) -> DataFrame:
    """Adds struct<risk_level, confidence, entropy, signals>."""
    limits = {**patterns.ANOMALY_DEFAULTS, **(limits or {})}
    signals = text_signals(text, "_entropy", limits) + ([] if account is None else [account])
    return (df.withColumn("_entropy", chars.entropy(F.col(text)))
            .withColumn("_signals", F.array_compact(F.array(*signals)))
            .withColumn("_risk", risk_of(F.col("_signals")))
            .transform(computed_once, out, F.struct("_risk.risk_level", "_risk.confidence",
                                      F.col("_entropy").alias("entropy"), F.col("_signals").alias("signals")))
            .drop("_entropy", "_signals", "_risk"))


def long_signals(df: DataFrame, key: str, column="anomaly") -> DataFrame:
    return explode_rows(df, key, F.col(column)["signals"], "s", "position").select(key, "position", "s.*")


def risk_per_key(signals: DataFrame, key: str) -> DataFrame:
    """The same risk level from a long signal table: four conditional counts."""
    n = lambda sev: F.count_if(F.col("severity") == sev)
    return signals.groupBy(key).agg(
        risk(n("CRITICAL"), n("HIGH"), n("MEDIUM"), n("LOW")).alias("risk_level"),
        F.avg("confidence").alias("confidence"), F.count("*").alias("signals"))


def as_findings(signals: DataFrame, key: str, location="readme/account") -> DataFrame:
    """Signals in the shape of the findings table."""
    return signals.select(
        key, F.lit("malicious_repository").alias("type"), F.col("type").alias("rule"), "severity",
        F.lit("malicious_detector").alias("source"), F.lit(location).alias("location"),
        "evidence", "confidence")
