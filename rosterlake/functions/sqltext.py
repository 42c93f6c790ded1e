"""Pieces of SQL expression text.

Rule tables become a few long SQL expressions.  Writing them as text costs one
parser call each; the same trees built from Column calls cost thousands of
driver round trips before a job even starts.
"""

EVIDENCE = "ARRAY<STRUCT<type: STRING, source: STRING, rule: STRING, matched: STRING, score: DOUBLE, confidence: DOUBLE>>"
NO_EVIDENCE = f"CAST(array() AS {EVIDENCE})"


def quote(value) -> str:
    """SQL string literal."""
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def num(value) -> str:
    return f"{float(value)!r}D"


def any_of(expr: str, words) -> str:
    """Any of the substrings occurs."""
    tests = " OR ".join(f"contains({expr}, {quote(w)})" for w in words)
    return f"({tests})" if tests else "false"


def first_of(expr: str, words) -> str:
    """First word of an ordered list that occurs, NULL if none."""
    return "CASE " + " ".join(f"WHEN contains({expr}, {quote(w)}) THEN {quote(w)}" for w in words) + " END"


def ladder(pairs, otherwise: str) -> str:
    """CASE over ordered (condition, value) pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def evidence(kind, source, rule, matched: str, confidence, score=0.0) -> str:
    """Evidence struct; ``matched`` (and ``kind``/``source`` when they start with
    a parenthesis) are SQL expressions, the rest plain values."""
    value = lambda v: v if v.startswith("(") else quote(v)
    return (f"named_struct('type', {value(kind)}, 'source', {value(source)}, 'rule', {quote(rule)}, "
            f"'matched', {matched}, 'score', {num(score)}, 'confidence', {num(confidence)})")


def when(condition: str, item: str) -> str:
    """One-element evidence array where the condition holds, else empty."""
    return f"IF({condition}, array({item}), {NO_EVIDENCE})"
