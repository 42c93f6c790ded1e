"""Source divergence audit against a plain recount of the definition."""

import random
import re
from collections import Counter, defaultdict

import pytest

from rosterlake.llm import divergence
from rosterlake.llm.book import load

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
UNIT = 10**9


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(rows):
    """rows of (text, lang, source)"""
    docs = [(Counter(terms(t)), lang or "", source or "") for t, lang, source in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for c, lang, source in docs:
        held[lang].update(c.keys())
        counts[lang, source] += c
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= 3]
        share = lambda c: {t: 1 + UNIT * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, gap(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, 200)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def made(n, seed=1, sources=7):
    rng = random.Random(seed)
    words = ["the", "THE", "of", "été", "naïve", "日本", "x", "data", "Straße", "a1b", "don't", "end.", "-", "42"]
    words += [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    return [(" ".join(rng.choices(words, weights=[9] * 14 + [1] * 120, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]),
             rng.choice([None, "src0", "src0", "src0", *(f"s{k}" for k in range(sources))])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def test_equals_recount(spark):
    rows = made(150)
    assert result(divergence.divergences(frame(spark, rows).repartition(5))) == brute(rows)


def test_many_tiles_blocks_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "TERMS", 7)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    monkeypatch.setattr(divergence, "BLOCK", 8)
    rows = made(120, seed=2, sources=9)
    assert result(divergence.divergences(frame(spark, rows).repartition(3))) == brute(rows)


def test_hot_source_and_copies(spark):
    rows = made(40, seed=3) + [("the same words again and again", "en", "src0")] * 300
    assert result(divergence.divergences(frame(spark, rows).repartition(4))) == brute(rows)


@pytest.mark.parametrize("rows", [
    [(None, None, None)], [("", "en", "a"), ("", "en", "b")], [("1 2 3 ...", "en", "a")] * 4,
    [("one", "en", "a"), ("one", "en", "b")], [("one two", "en", "a")] * 3 + [(None, "en", "b")],
], ids=["null", "empty", "no terms", "rare", "a group without terms"])
def test_small(spark, rows):
    assert result(divergence.divergences(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert result(divergence.divergences(frame(spark, []))) == []


def test_one_source_has_no_pairs(spark):
    rows = [("alpha beta", "en", "a")] * 5
    assert result(divergence.divergences(frame(spark, rows))) == brute(rows) == []


def test_long_text(spark):
    rows = [("word " * 400_000 + "x" * 300_000, "en", "a")] + [("word other", "en", s) for s in "abc"]
    assert result(divergence.divergences(frame(spark, rows))) == brute(rows)


def test_clashing_columns(spark):
    rows = made(30, seed=4)
    df = frame(spark, rows)
    names = ["term", "n", "docs", "lead", "p", "p0", "at", "kinds", "total", "holders", "value", "rank", "part", "item", "block", "TERM "]
    wide = df.selectExpr("*", *[f"'z' AS `{x}`" for x in names])
    assert result(divergence.divergences(wide)) == brute(rows)


def test_query_reads_whole_tables(spark, stored):
    rows = made(60, seed=5)
    folder = stored([(k, t, lang, source) for k, (t, lang, source) in enumerate(rows)])
    queries, _ = load()
    assert result(queries["op13_source_divergence"](spark, folder)) == brute(rows)


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    n = 5 * 10**10
    df = spark.createDataFrame([(n, 10**11, 7)], "n long, total long, kinds long")
    got = df.select(divergence._share(F.col("n"), F.col("total"), F.col("kinds"))).first()[0]
    assert got == 1 + UNIT * (n + 1) // (10**11 + 7)
