"""The registry job end to end: one lazy chain from raw records to verdicts.

raw -> normalise -> resolve -> relevance -> classify -> identity -> scan ->
promote -> quality.  Only resolve shuffles: the records once on the canonical
id, their list items once on (id, list, item); everything else is per row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls
from ..functions.arrays import computed_once
from ..operators import anomaly, classify, findings, identity, lifecycle, match, quality, relevance, resolve, views
from ..rules import patterns, signals
from ..schemas import with_defaults
from ..sinks import tables

# fixed values: which steps a mode runs
MODES = {
    "full": ("normalise", "resolve", "relevance", "classify", "identity", "runtime", "scan", "promote", "quality"),
    "discovery-only": ("normalise", "resolve"),
    "classify-only": ("relevance", "classify"),
    "verify-only": ("discovered", "runtime"),
}


def normalise(raw: DataFrame, known_sources=signals.KNOWN_SOURCES) -> DataFrame:
    """Defaults, slug, owner and name from the URL where they are missing, cleaned
    description and content, endpoints named in the readme before the listed
    ones, transports, known data sources after the given ones."""
    df = with_defaults(raw, ("name", "slug", "description", "raw_content", "repo_url", "repo_owner", "repo_name",
                             "homepage", "language", "license", "topics", "package_files", "endpoints", "tools",
                             "resources", "data_sources", "sources", "stars", "forks"))
    name = urls.default_name(F.col("name"), F.col("repo_url"))
    df = df.withColumns({
        "raw_content": T.redact(F.col("raw_content")),
        "repo_owner": F.coalesce(T.nonblank(F.col("repo_owner")), urls.owner(F.col("repo_url")), F.lit("")),
        "repo_name": F.coalesce(T.nonblank(F.col("repo_name")), urls.last_segment(F.col("repo_url")), F.lit(""))})
    readme = F.transform(urls.readme_endpoints(F.col("raw_content")), lambda e: F.struct(
        e["url"].alias("url"), e["transport"].alias("transport"), e["tls"].alias("tls"), F.lit("").alias("type")))
    df = df.withColumn("endpoints", F.concat(readme, F.col("endpoints")))
    named = F.concat(F.array("repo_url", "homepage"), F.transform("endpoints", lambda e: e["url"]))
    return df.withColumns({
        "name": name, "slug": urls.slug(name), "transport": urls.endpoint_transports(F.col("endpoints")),
        "description": T.describe(F.col("description"), F.col("raw_content")),
        "data_sources": F.concat("data_sources", match.known_sources(named, F.col("raw_content"), known_sources)),
        "license": T.license_or_unknown(F.col("license"))})


SCALARS = ("name", "slug", "description", "repo_url", "repo_owner", "repo_name", "homepage", "language", "license",
           "topics", "package_files", "stars", "forks", "pushed_at", "endpoints", "tools", "resources",
           "data_sources", "sources")


def resolve_entities(df: DataFrame, trust="trust", seq="seq") -> DataFrame:
    """One row per canonical id: scalars of the most trusted record, lists merged
    over all records.  ``(trust, seq)`` must tell records apart; records without
    URL, name and fingerprint stay entities of their own.  The winner is found
    on narrow columns, so texts are moved once and never sorted.  For lists too
    long for a row see ``resolve.merge_items``."""
    keyed = resolve.with_own_id(resolve.with_canonical_id(df), seq=seq)
    # the filters that joins infer from the id would normalise every record a second time below it
    keyed = keyed.transform(computed_once, "cid", F.col("cid"))
    lists = [c for c in resolve.LIST_KEYS if c in keyed.columns]
    cols = [c for c in SCALARS if c in keyed.columns and c not in lists]
    rows = resolve.merge_scalars(keyed, "cid", trust, seq, scalars=cols)
    merged = resolve.merge_lists(keyed.select("cid", trust, seq, *lists), trust=trust, seq=seq)
    kinds = dict(keyed.dtypes)
    filled = {c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in lists}
    return rows.join(merged, "cid", "left").withColumns(filled).withColumnRenamed("cid", "id")


def score(df: DataFrame, region=None, ai=None) -> DataFrame:
    out = relevance.add(df, "_region", region or relevance.region())
    out = relevance.add(out, "_ai", ai or relevance.ai())
    return out.withColumns({
        "region_score": F.col("_region.score"), "region_level": F.col("_region.level"),
        "ai_score": F.col("_ai.score"), "ai_level": F.col("_ai.level")}).drop("_region", "_ai")


def assign_class(df: DataFrame) -> DataFrame:
    if "identity_status" not in df.columns:
        df = df.withColumn("identity_status", F.lit("CANDIDATE"))
    out = classify.classify(df)
    return out.withColumns({"primary_class": F.col("classification.primary"),
                            "class_confidence": F.col("classification.confidence")}).drop("classification")


def assign_identity(df: DataFrame, as_of: Column, detector=False) -> DataFrame:
    """Identity by the live shortcut or the full detector; the check time is set
    here, which is what lets promotion fire."""
    if detector:
        found = identity.detect(df)
        out = found.withColumns({"identity_status": F.col("identity.status"), "role": F.col("identity.role")}).drop("identity")
    else:
        out = df.withColumn("identity_status", identity.shortcut_status(F.col("primary_class")))
    return out.withColumns({"protocol_related": classify.is_protocol_class(F.col("primary_class")),
                            "static_checked_at": as_of})


def mark_runtime(df: DataFrame, verdicts: DataFrame = None, key="id") -> DataFrame:
    """Runtime verdict from a probe log; without one, listed endpoints count."""
    if verdicts is None:
        return df.withColumn("runtime_status", F.when(F.size("endpoints") > 0, "PASSED"))
    v = verdicts.select(key, F.col("status").alias("runtime_status"))
    return df.join(v, key, "left")


def scan_first(df: DataFrame, rules=patterns.LEGACY_RULES, families=patterns.LEGACY_FAMILIES, limits=None) -> DataFrame:
    """First-generation scan of the content: rules, secrets and text anomalies in
    one verdict; every match and every anomaly is a finding."""
    hit = findings.with_hits(df, "raw_content", rules, families, out="_hits")
    both = anomaly.detect(hit, "raw_content", out="_odd", limits=limits)
    hits, odd = F.col("_hits"), F.col("_odd.signals")
    has = lambda *levels: (F.exists(hits, lambda h: h["severity"].isin(*levels))
                           | F.exists(odd, lambda s: s["severity"].isin(*levels)))
    total = F.aggregate(hits, F.lit(0), lambda n, h: n + h["hits"]) + F.size(odd)
    weight = (F.aggregate(hits, F.lit(0.0), lambda w, h: w + h["hits"] * h["confidence"])
              + F.aggregate(odd, F.lit(0.0), lambda w, s: w + s["confidence"]))
    return both.withColumns({
        "security_status": findings.status_of(has("CRITICAL", "HIGH"), has("MEDIUM")), "findings": total,
        "security_confidence": F.coalesce(F.try_divide(weight, total), F.lit(1.0))}).drop("_hits", "_odd")


def scan(df: DataFrame, rules=patterns.SCAN_RULES, families=patterns.SCAN_FAMILIES) -> DataFrame:
    out = findings.verdict(df.withColumn("_scan", findings.assemble(df)), "_scan", rules, families)
    return out.withColumns({"security_status": F.col("security.status"),
                            "findings": F.col("security.findings"),
                            "security_confidence": F.col("security.confidence")}).drop("security", "_scan")


def promote(df: DataFrame) -> DataFrame:
    return df.withColumn("identity_status", lifecycle.promote_gated(
        F.col("identity_status"), F.col("static_checked_at").isNotNull(), F.col("runtime_status"),
        F.col("security_status")))


def rate(df: DataFrame, as_of: Column) -> DataFrame:
    out = quality.add(df, quality.engine_components(as_of))
    return out.withColumns({"quality_score": F.col("quality.score"), "quality_grade": F.col("quality.grade"),
                            "health_points": F.col("quality.components.health")}).drop("quality")


def build(raw: DataFrame, as_of: Column, mode="full", region=None, ai=None, probes: DataFrame = None,
          detector=False, security="second", rules=None, families=None, limits=None, trust="trust", seq="seq") -> DataFrame:
    """Runs the steps of a mode as one plan.

    ``security`` picks the generation of the scan; ``rules`` and ``families``
    replace its tables.
    """
    first = security == "first"
    rules = rules or (patterns.LEGACY_RULES if first else patterns.SCAN_RULES)
    families = families or (patterns.LEGACY_FAMILIES if first else patterns.SCAN_FAMILIES)
    steps = {
        "normalise": normalise,
        "resolve": lambda df: resolve_entities(df, trust, seq),
        "relevance": lambda df: score(df, region, ai),
        "classify": assign_class,
        "identity": lambda df: assign_identity(df, as_of, detector),
        "runtime": lambda df: mark_runtime(df, probes),
        "discovered": lambda df: df.filter(F.col("entity_status") == "DISCOVERED"),
        "scan": lambda df: scan_first(df, rules, families, limits) if first else scan(df, rules, families),
        "promote": promote,
        "quality": lambda df: rate(df, as_of),
    }
    out = raw
    for step in MODES[mode]:
        out = out.transform(steps[step])
    return out


def persist(stored: DataFrame, built: DataFrame, key="id") -> DataFrame:
    """The stored entities after an idempotent upsert of a build's rows."""
    return tables.upsert(stored, built, key)


def publish(entities: DataFrame, catalogue=None) -> DataFrame:
    """View flags of the entities, as the last step of a full run."""
    return views.flags(entities, catalogue)


def assemble(entities: DataFrame, *verdicts: DataFrame, key="id") -> DataFrame:
    """Entities with separately computed verdict tables joined on one key."""
    out = entities
    for v in verdicts:
        out = out.join(v, key, "left")
    return out
