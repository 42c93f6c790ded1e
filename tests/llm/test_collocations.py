"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from rosterlake.llm import collocations
from rosterlake.llm.book import load

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP))]


def phrase_counts(docs):
    f = {}
    for _, text, lang in docs:
        c = f.setdefault("und" if lang is None else lang, Counter())
        for w in pieces(text):
            for k in range(1, 5):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f


def brute(docs, support=30, best=2000, cover=80):
    out = []
    for lang, f in phrase_counts(docs).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cands = [p for p, c in f.items() if len(p) > 1 and c >= support]
        around = Counter()
        for p in cands:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i:i + k]] = max(around[p[i:i + k]], f[p])
        rows = []
        for p in cands:
            a = f[p]
            if p in around and 100 * around[p] >= cover * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        rows.sort()
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(rows[:best], 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "state", "Ünï", "日本", "x", "a-b", " ", "é"] + [f"w{k}" for k in range(40)]
    fixed = ["new york city hall", "in the middle of", "as well as", "one two three four five six"]
    docs = []
    for k in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) + rng.choice(["", "", "", "", ".", ",", "!", "\n", "\r\n", "\x0b", "\t"])
                 for _ in range(rng.randint(0, 40))]
        docs.append((k, " ".join(parts), rng.choice(["en", "en", "de", None, ""])))
    return docs


def test_equals_plain_count(spark):
    docs = made(400)
    assert result(collocations.collocations(frame(spark, docs).repartition(4))) == brute(docs)


@pytest.mark.parametrize("share", [0.02, 0.3, 1.0])
def test_any_sample_gives_the_same(spark, share, monkeypatch):
    for name, value in (("HELD", 500), ("KEPT", 900), ("RECENT", 4), ("LEAST_BITS", 7), ("MOST_BITS", 12)):
        monkeypatch.setattr(collocations, name, value)
    docs = made(150, seed=2)
    got = collocations.collocations(frame(spark, docs).repartition(3), support=8, best=50, share=share)
    assert result(got) == brute(docs, support=8, best=50)


def test_border_failures_lead_to_more_passes(spark):
    """Phrases that the sample lacks altogether are found, one pass for each length."""
    docs = made(80, seed=3)
    df = frame(spark, docs + [(None, "rare unseen phrase here", "en")] * 40)
    sampled = df.filter("doc_id is not null")
    passes = []
    from rosterlake.llm.sampling import PARTS, part
    from pyspark.sql import functions as F
    share = 0.3
    hidden = sampled.filter(part(F.col("doc_id"), F.lit(29)) >= int(PARTS * share) + 1)
    rows = [tuple(r) for r in hidden.collect()]
    unseen = [(i, (t or "") + " . " + "rare unseen phrase here", lang) for i, t, lang in rows]
    seen = [tuple(r) for r in sampled.filter(part(F.col("doc_id"), F.lit(29)) < int(PARTS * share) + 1).collect()]
    docs = unseen + seen
    found = collocations.frequent(frame(spark, docs), support=20, share=share, passes=passes)
    assert found.count() == sum(1 for f in phrase_counts(docs).values() for c in f.values() if c >= 20)
    assert found.select("key").distinct().count() == found.count()
    assert len(passes) >= 3
    assert result(collocations.collocations(frame(spark, docs), support=20, share=share)) == brute(docs, support=20)


def test_copies_and_overlaps(spark):
    docs = [(k, "buffalo buffalo buffalo buffalo buffalo", "en") for k in range(50)] + [(k, "a b c d e f g", "de") for k in range(200)]
    assert result(collocations.collocations(frame(spark, docs).repartition(4))) == brute(docs)


@pytest.mark.parametrize("docs", [[], [(1, None, None)], [(1, "", "en")], [(1, ". , ;", "en")], [(1, "a b", "en")] * 29,
                                  [(None, "a b", None)] * 30],
                         ids=["empty", "null", "empty text", "stops", "just below", "just reached"])
def test_small(spark, docs):
    assert result(collocations.collocations(frame(spark, docs))) == brute(docs)


def test_long_text_is_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefg") + rng.choice(["", "", "", "."]) for _ in range(5000)) + " " + "x y z " * 500
    docs = [(1, text, "en"), (2, "a b c. " * 50, "en"), (3, None, "en")]
    assert result(collocations.collocations(frame(spark, docs), share=1.0)) == brute(docs)


def test_clashing_columns(spark):
    docs = made(60, seed=5)
    wide = frame(spark, docs).selectExpr("*", *[f"'z' AS `{x}`" for x in ("key", "n", "a", "l", "r", "phrase", "rank", "score", "inner", "cuts", "at")])
    assert result(collocations.collocations(wide, support=5)) == brute(docs, support=5)


def test_filter_never_misses(spark):
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long")
    bits = collocations.filter_of(df, 16)
    assert collocations.admitted(bits, keys).all()
    assert collocations.admitted(bits, rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)).mean() < 0.05


def test_query_against_its_sql(spark, stored):
    import duckdb
    from check_oracles import compare
    docs = made(300, seed=7)
    folder = stored([(i, t, lang) for i, t, lang in docs])
    queries, sql = load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    verdict, _, ok = compare(spark, con, folder, "op12_phrase_collocations", queries["op12_phrase_collocations"], sql["op12_phrase_collocations"])
    assert ok, verdict
