"""Finding extraction: many regex rules over long texts, JVM only.

Three levels of output, each as cheap as it can be:

* ``counts``   hits per rule, one projection, no shuffle
* ``verdict``  status and mean confidence per row, derived from the counts
* ``extract``  one row per match with its surrounding text

A rule is tried only on rows that contain one of its ``needles``; a plain
substring test is far cheaper than a regex, and almost every (row, rule) pair
ends there.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import regex, sqltext as S
from ..functions.arrays import computed_once, explode_rows
from ..rules import patterns, vocab


def assemble(df: DataFrame) -> Column:
    """Text scanned for an entity: content, description, slug, the descriptions
    of tools and resources, and data-source URLs."""
    parts = F.concat(
        F.array("raw_content", "description", "slug"),
        F.transform("tools", lambda t: t["description"]),
        F.transform("resources", lambda r: r["description"]),
        F.transform("data_sources", lambda d: d["url"]))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")


# ASCII punctuation that prose seldom has; one pass leaves the marks of a text,
# and most rules end at a look into that short string
_MARKS = "!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~-"
_NO_MARKS = "[^" + "".join("\\" + c for c in _MARKS) + "]+"


def _has_marks(chars, marks="_marks") -> list:
    return [f"contains({marks}, {S.quote(c)})" for c in dict.fromkeys(chars) if c in _MARKS]


def _gate(rule, folded="_folded") -> str:
    """Necessary condition for a match: its marks, then one of its needles; a
    needle's own punctuation is looked up first."""
    needles = [" AND ".join([*_has_marks(n), f"contains({folded}, {S.quote(n)})"]) for n in rule.needles]
    tests = _has_marks(rule.marks) + (["(" + " OR ".join(f"({n})" for n in needles) + ")"] if needles else [])
    return " AND ".join(tests) or "true"


def _may_match(text: str, rule) -> str:
    """A needle occurs and then the pattern does, in this order."""
    return f"({_gate(rule)} AND rlike({text}, {S.quote(regex.jvm(rule.pattern))}))"


def _with_folded(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({"_folded": regex.fold_case(F.col(text)),
                           "_marks": F.coalesce(F.regexp_replace(text, _NO_MARKS, ""), F.lit(""))})


def hit_structs(text: str, rules, families) -> Column:
    """array<struct<type, rule, severity, confidence, hits>> of rules that fire."""
    def item(r):
        return (f"named_struct('type', {S.quote(r.family)}, 'rule', {S.quote(r.rule)}, 'severity', {S.quote(r.severity)}, "
                f"'confidence', {S.num(families[r.family].confidence)}, "
                f"'hits', regexp_count({text}, {S.quote(regex.jvm(r.pattern))}))")
    # counted without a test before: a text whose only match is near its end is read once
    counted = "array_compact(array(" + ", ".join(f"IF({_gate(r)}, {item(r)}, NULL)" for r in rules) + "))"
    return F.expr(f"filter({counted}, h -> h.hits > 0)")


def with_hits(df: DataFrame, text: str, rules=patterns.SCAN_RULES, families=patterns.SCAN_FAMILIES,
              out="rule_hits") -> DataFrame:
    return _with_folded(df, text).withColumn(out, hit_structs(text, rules, families)).drop("_folded", "_marks")


def counts(df: DataFrame, key: str, text: str, rules=patterns.SCAN_RULES,
           families=patterns.SCAN_FAMILIES) -> DataFrame:
    """Long table (key, type, rule, severity, confidence, hits)."""
    hits = with_hits(df.select(key, text), text, rules, families)
    return explode_rows(hits, key, F.col("rule_hits"), "h").select(key, "h.*")


def status_of(has_severe: Column, has_medium: Column) -> Column:
    return F.when(has_severe, "QUARANTINED").when(has_medium, "SUSPICIOUS").otherwise("CLEAN")


def verdict(df: DataFrame, text: str, rules=patterns.SCAN_RULES, families=patterns.SCAN_FAMILIES,
            out="security") -> DataFrame:
    """Adds struct<status, confidence, findings> without a shuffle."""
    hits = F.col("_hits")
    total = F.aggregate(hits, F.lit(0), lambda acc, h: acc + h["hits"])
    weight = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["hits"] * h["confidence"])
    severe = F.exists(hits, lambda h: h["severity"].isin("CRITICAL", "HIGH"))
    medium = F.exists(hits, lambda h: h["severity"] == "MEDIUM")
    return (with_hits(df, text, rules, families, out="_hits")
            .transform(computed_once, out, F.struct(
                status_of(severe, medium).alias("status"),
                F.coalesce(F.try_divide(weight, total), F.lit(1.0)).alias("confidence"),
                total.alias("findings")))
            .drop("_hits"))


def _surroundings(found: Column, between: Column, width: Column, most: int) -> Column:
    """struct<left, right>: the ``width`` characters before match i are left[i], those after it right[i + 1].

    A side starts as the neighbouring piece with the match at its far end.  In each round a side that is still short
    takes what the element 1, 2, 4, ... places on has gathered; every match is at least one character long, so
    log2(``most``) rounds are enough.
    """
    def shifted(x, places, front):
        n = F.least(F.size(x), F.lit(places))
        blank, kept = F.array_repeat(F.lit(""), n), F.slice(x, F.lit(1) if front else n + 1, F.size(x) - n)
        return F.concat(blank, kept) if front else F.concat(kept, blank)

    def grown(start, front):
        cut = (lambda s: F.right(s, width)) if front else (lambda s: F.left(s, width))

        def widen(x, places):
            longer = F.zip_with(x, shifted(x, places, front), lambda own, more: F.when(F.length(own) >= width, own).otherwise(
                cut(F.concat(more, own) if front else F.concat(own, more))))
            # matches mostly stand further apart than the width
            return F.when(F.exists(x, lambda s: F.length(s) < width), longer).otherwise(x)
        return F.aggregate(F.array(*[F.lit(1 << k) for k in range(max(most - 1, 0).bit_length())]).cast("array<int>"), start, widen)

    none = F.array(F.lit(""))
    ahead = F.zip_with(F.concat(none, F.transform(found, lambda s: F.right(s, width))), between,
                       lambda m, b: F.right(F.concat(m, F.right(b, width)), width))
    behind = F.zip_with(between, F.concat(F.transform(found, lambda s: F.left(s, width)), none),
                        lambda b, m: F.left(F.concat(F.left(b, width), m), width))
    return F.struct(grown(ahead, True).alias("left"), grown(behind, False).alias("right"))


def extract(df: DataFrame, key: str, text: str, rules=patterns.SCAN_RULES,
            families=patterns.SCAN_FAMILIES) -> DataFrame:
    """One row per match with up to ``context`` characters on both sides.

    ``split`` gives the text between matches and ``regexp_extract_all`` the
    matches.  Pieces are cut to the context width first; the text on either
    side of every match then comes from ``_surroundings``.  The evidence is put
    together inside the row and only finished matches are exploded, so work and
    memory are linear in text and matches.
    """
    def item(r):
        family, pattern = families[r.family], S.quote(regex.jvm(r.pattern))
        return (f"named_struct('type', {S.quote(r.family)}, 'rule', {S.quote(r.rule)}, 'severity', {S.quote(r.severity)}, "
                f"'source', {S.quote(family.source)}, 'confidence', {S.num(family.confidence)}, "
                f"'context', {family.context}, 'found', regexp_extract_all({text}, {pattern}, 0), "
                f"'between', split({text}, {pattern}, -1))")
    fired = F.expr("array_compact(array(" + ", ".join(
        f"IF({_may_match(text, r)}, {item(r)}, NULL)" for r in rules) + "))")
    per_rule = explode_rows(_with_folded(df.select(key, text), text), key, fired, "f").select(key, "f.*")
    most = max((families[r.family].context for r in rules), default=0)
    # one struct of arrays, computed in place: the lambda below reads it for every match
    around = per_rule.transform(computed_once, "a", _surroundings(F.col("found"), F.col("between"), F.col("context"), most)) \
                     .drop("between")

    def finished(matched, pos):
        return F.struct(matched.alias("matched"), F.concat(F.get("a.left", pos), matched, F.get("a.right", pos + 1)).alias("evidence"))

    kept = [key, "type", "rule", "severity", "source", "confidence"]
    each = explode_rows(around, kept, F.transform("found", finished), "m", "position")
    return each.select(
        key, "type", "rule", "severity", "source", F.lit("readme/source").alias("location"),
        "position", "m.matched", "m.evidence", "confidence")


def summarise(findings: DataFrame, key: str, hits: str = None) -> DataFrame:
    """Verdict per key from a long findings table.

    ``hits`` names a multiplicity column when rows stand for several matches.
    """
    n = F.lit(1) if hits is None else F.col(hits)
    severity = F.upper("severity")
    return (findings.groupBy(key).agg(
        F.bool_or(severity.isin("CRITICAL", "HIGH")).alias("_severe"),
        F.bool_or(severity == "MEDIUM").alias("_medium"),
        F.sum(n).alias("findings"),
        (F.sum(n * F.col("confidence")) / F.sum(n)).alias("confidence"))
        .withColumn("status", status_of(F.col("_severe"), F.col("_medium"))).drop("_severe", "_medium"))


def verdict_for_all(df: DataFrame, findings: DataFrame, key: str, hits: str = None) -> DataFrame:
    """Every key of ``df``; keys without findings are CLEAN with confidence 1."""
    return (df.select(key).join(summarise(findings, key, hits), key, "left")
            .select(key, F.coalesce("status", F.lit("CLEAN")).alias("status"),
                    F.coalesce("findings", F.lit(0)).alias("findings"),
                    F.coalesce("confidence", F.lit(1.0)).alias("confidence")))


def apply_overrides(verdicts: DataFrame, overrides: DataFrame, key: str, status="status") -> DataFrame:
    """Manual decisions (``key, status``) replace the scanner's; the only way to
    reach BLOCKED, which no rule emits."""
    manual = overrides.groupBy(key).agg(F.max(status).alias("_manual"))
    return (verdicts.join(manual, key, "left")
            .withColumn(status, F.coalesce("_manual", status)).drop("_manual"))


def is_injection(kind: Column, rule: Column) -> Column:
    return F.lower(F.concat_ws(" ", kind, rule)).rlike("injection|prompt")


def severity_rank(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(severity)), F.lit(0))


def rank_severity(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ("NONE",) + tuple(vocab.SEVERITY_RANK)]), rank + 1)


def is_safe_for_registry(status: Column) -> Column:
    return ~status.isin("BLOCKED", "QUARANTINED")


def is_listable(status: Column) -> Column:
    return status != "BLOCKED"
