"""Dictionary matching without a join.

A dictionary is configuration: a few hundred words at most.  It is folded into
the plan as literals, so matching is a map-side projection: no cross join, no
broadcast, no shuffle, and the number of output rows is the number of hits.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sqltext as S, text as T
from ..functions.arrays import explode_rows


class Term(NamedTuple):
    word: str
    points: float = 0.0
    label: str = ""


def terms(words, points=0.0, label="") -> list:
    return [Term(w, float(points), label) for w in words]


def _literal(t: Term) -> str:
    return f"named_struct('word', {S.quote(t.word)}, 'points', {S.num(t.points)}, 'label', {S.quote(t.label)})"


def hits_sql(expr: str, dictionary, match="contains") -> str:
    """``hits`` as SQL text over an expression."""
    low = f"lower({expr})"
    if not dictionary:
        return f"CAST(array() AS {_HITS})"
    const = ", ".join(f"named_struct('low', {S.quote(t.word.lower())}, 'pattern', "
                      f"{S.quote(T.word_pattern(t.word.lower()) if match == 'word' else '')}, 'term', {_literal(t)})" for t in dictionary)
    # the variable must not shadow a column of the caller's expression; whole words are looked for where the word occurs
    test = "contains(_low, _entry.low)" + (" AND rlike(_low, _entry.pattern)" if match == "word" else "")
    # the lower-cased text is computed once, as the only element of an array
    return (f"transform(flatten(transform(array({low}), _low -> filter(array({const}), _entry -> {test}))), "
            "_entry -> _entry.term)")


_HITS = "ARRAY<STRUCT<word: STRING, points: DOUBLE, label: STRING>>"


def hits(text: str, dictionary, match="contains") -> Column:
    """array<struct<word, points, label>> of the terms found, dictionary order.

    ``text`` is a column name or SQL expression.  ``match='contains'`` is a
    case-insensitive substring test; ``'word'`` asks for whole words.  The
    plan is one filter over a constant array, whatever the dictionary's size.
    """
    return F.expr(hits_sql(text, dictionary, match))


def first_hit(text: str, dictionary, match="contains") -> Column:
    """First term in dictionary order, NULL when none occurs."""
    return F.get(hits(text, dictionary, match), F.lit(0))


def long_hits(df: DataFrame, key, text: str, dictionary, match="contains") -> DataFrame:
    """One row per (row, term) hit."""
    keys = [key] if isinstance(key, str) else list(key)
    return explode_rows(df, keys, hits(text, dictionary, match), "hit") \
        .select(*keys, "hit.word", "hit.points", "hit.label")


def url_domains_sql(urls: str, domains, every=False) -> str:
    """Domains found in an array of URLs, as SQL text.

    ``every=False`` keeps the first dictionary domain per URL, ``True`` all of
    them (``data.example`` also counts for ``example``).
    """
    if every:
        return f"transform(flatten(transform({urls}, u -> {hits_sql('u', terms(domains))})), h -> h.word)"
    return f"array_compact(transform({urls}, u -> {S.first_of('lower(u)', [d.lower() for d in domains])}))"


def url_domains(urls: str, domains, every=False) -> Column:
    return F.expr(url_domains_sql(urls, domains, every))


def known_sources(urls: Column, readme: Column, table: dict) -> Column:
    """array<struct<name,type,url,official>>, one per domain.

    The first URL that names a domain wins; a mention in the readme counts only
    for domains no URL named, and has an empty ``url``.
    """
    def entry(domain, kind, low_readme):
        where = F.filter(urls, lambda u: F.contains(F.lower(u), F.lit(domain)))
        found = F.when(F.size(where) > 0, F.get(where, F.lit(0))) \
                 .when(F.contains(low_readme, F.lit(domain)), F.lit(""))
        return F.when(found.isNotNull(), F.struct(
            F.lit(domain).alias("name"), F.lit(kind).alias("type"), found.alias("url"),
            F.lit(kind in ("official_gov_api", "official_company")).alias("official")))

    # the lower-cased readme is computed once, as the only element of an array
    return F.get(F.transform(F.array(F.lower(readme)), lambda low: F.array_compact(
        F.array(*[entry(d, k, low) for d, k in table.items()]))), F.lit(0))
