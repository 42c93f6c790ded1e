"""Quality rules: counts against a plain reading of their definition, estimation against a row-wise version."""

import random
import re

import numpy as np

from rosterlake.llm import quality
from rosterlake.llm.book import load

OP = load()[0]["op1_quality_rules"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 200 else g in many(grams):
            hit |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit)


def many(grams, memo={}):  # noqa: B006
    key = id(grams)
    if memo.get("key") != key:
        seen, again = set(), set()
        for g in grams:
            (again if g in seen else seen).add(g)
        memo.update(key=key, again=again, hold=grams)
    return memo["again"]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert tuple(r[c] for c in COUNTS) == want, r.doc_id
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and (r.kept is False if failed else r.kept == (r.p_good >= quality.KEEP_FROM))


def test_given_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = OP(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check(rows, texts)


def test_edge_rows(spark, stored):
    rng = random.Random(0)
    loop = " ".join(rng.choice("ab") for _ in range(60))
    docs = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "a b c d e a b c d e"), (5, "a b c d e x a b c d e\n"), (6, "l\nl\n \n \nl \nl"), (7, loop),
            (8, "é\u00a0中 \u2003 ###"), (9, "w " * 50_000), (10, "A B C D E a b c d e"), (11, "a\nb c d\re\x0cf a b c d e f"), (None, "a b")]
    texts = dict(docs)
    check(OP(spark, stored(docs + [(4, texts[4])])).collect(), texts)


def test_empty_table_and_extra_columns(docs_of):
    from pyspark.sql import functions as F
    assert quality.judged(docs_of([])).collect() == []
    docs = docs_of([(1, "a b")]).withColumn("n_words", F.lit(9)).withColumn("kept", F.lit("x")).withColumn("vote_length", F.lit(0))
    assert [(r.n_words, r.kept) for r in quality.judged(docs).collect()] == [(2, False)]


def row_wise(votes, prior, rounds):
    """The same estimation, one document after the other."""
    accuracy = [quality.RIGHT] * len(votes[0])
    for _ in range(rounds):
        good = []
        for v in votes:
            p, q = prior, 1 - prior
            for x, a in zip(v, accuracy):
                p *= a if x == 1 else 1 - a if x == -1 else 1
                q *= a if x == -1 else 1 - a if x == 1 else 1
            good.append(p / (p + q))
        for r in range(len(accuracy)):
            own = [g if v[r] == 1 else 1 - g for v, g in zip(votes, good) if v[r]]
            own = sum(own) / len(own) if own else quality.RIGHT
            accuracy[r] = min(quality.MOST, max(quality.LEAST, (own + quality.TRUST * quality.RIGHT) / (1 + quality.TRUST)))
    return accuracy


def test_estimation_over_patterns_equals_rows():
    rng = random.Random(5)
    votes = [tuple(rng.choices((-1, 0, 1), (1, 3, 4))[0] for _ in range(4)) for _ in range(200)]
    patterns = sorted(set(votes))
    got = quality.estimate(patterns, [votes.count(p) for p in patterns], rounds=25)
    assert np.allclose(got, row_wise(votes, quality.PRIOR, 25), atol=1e-6)


def test_corroborated_rule_gains_weight():
    # rules 0 and 1 agree with each other, rule 2 speaks alone
    patterns, counts = [(-1, -1, 0), (0, 0, -1), (0, 0, 0)], [20, 20, 400]
    accuracy = quality.estimate(patterns, counts)
    good = quality.posterior(patterns, quality.PRIOR, accuracy)
    assert accuracy[0] == accuracy[1] > accuracy[2] and good[0] < 0.5 < good[1] < good[2]


def test_clean_documents_are_kept(spark, sf_dir):
    rows = OP(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("quality = 1 and not base_failed").collect()
    assert sum(r.kept for r in rows) >= 0.99 * len(rows)


def test_mostly_lone_rule_decides_unless_spoken_against():
    # rule 0 mostly speaks alone, rule 3 seconds it at times; rule 1 fires beside the good vote of rule 2
    patterns = [(-1, 0, 0, 0), (-1, 0, 0, -1), (0, -1, 0, 0), (0, -1, 1, 0), (0, 0, 0, 0), (0, 0, 1, 0)]
    share, weights = quality.vote_weights(patterns, [30, 5, 5, 80, 50, 800])
    odds = [np.log(share / (1 - share)) + sum(w[v + 1] for w, v in zip(weights, p)) for p in patterns]
    assert max(odds[:2]) < 0 < min(odds[2:])
    assert (weights[:, 0] <= 0).all() and (weights[:, 1] == 0).all() and (weights[:, 2] >= 0).all()


def test_bad_documents_are_dropped(spark, sf_dir):
    rows = OP(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("quality = 0 and not base_failed").collect()
    assert rows and sum(not r.kept for r in rows) >= 0.9 * len(rows)
