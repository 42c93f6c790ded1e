"""The corpus pipeline against stage-by-stage brute force on a fixture, and over the given table."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
import test_decontaminate
import test_jaccard
import test_packing
from rosterlake.llm import pii
from rosterlake.llm.book import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tokenize():
    from tokenizers import Tokenizer

    from rosterlake.llm.common import vocabulary
    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def corpus():
    rng = random.Random(11)
    words = {"en": "the and of with house garden water green walks river".split(), "de": "der und das mit haus garten wasser geht fluss nicht".split()}
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        text = [rng.choice(words[lang]) + rng.choice(["", "er", "en", "s", "ly"]) for _ in range(rng.randint(30, 90))]
        docs.append([i, " ".join(text), lang, f"s{i % 3}"])
    for k in range(0, 20, 2):
        copy = docs[k][1].split()
        copy[rng.randrange(len(copy))] = "changed"
        docs.append([100 + k, " ".join(copy), docs[k][2], "s"])
        docs.append([200 + k, docs[k][1], docs[k][2], "s"])
    docs[5][1] += " " + item.upper()
    docs[7][1] += " write to a.b@mail.example.com or jane [at] example [dot] org"
    docs += [[300, "12 34 56 .", "en", "s"], [301, None, "de", "s"], [302, "", None, None], [303, docs[9][1] * 40, "de", None]]
    return [tuple(d) + (None if d[1] is None else len(d[1]),) for d in docs], [(1, item), (2, None)]


def brute(docs, items):
    kept = [d for d in docs if d[1] and any(map(str.isalpha, d[1]))]
    low = {i: c for i, _, c in test_jaccard.brute([d[:2] for d in kept])}
    kept = [d for d in kept if low[d[0]] == d[0]]
    bad = {r[0] for r in test_decontaminate.brute([d[:2] for d in kept], items) if r[-1]}
    kept = [d for d in kept if d[0] not in bad]
    return [(d[0], pii.masked(d[1], pii.all_spans(d[1])[1])) for d in kept]


def test_against_brute_force(spark, stored, tokenize):
    docs, items = corpus()
    path = stored(docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = corpus_pipeline.run(spark, path).collect()
    want = brute(docs, items)
    assert len(want) < len(docs) and any("<EMAIL> or <EMAIL>" in t for _, t in want)
    test_packing.check(got, want, tokenize)


def test_stages_over_given_table(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == COLUMNS
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        rows = after.select("doc_id").collect()
        assert len(rows) == len({r.doc_id for r in rows}) and {r.doc_id for r in rows} <= ids
    assert entry.queries()["pipeline"](spark, sf_dir).count() > 0


def test_empty_repeated_and_extra_columns(spark, docs_of, stored):
    from pyspark.sql import functions as F
    docs, items = corpus()
    path = stored(docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    odd = docs_of(docs + docs[:5] + [(None, docs[0][1], "en", None, 3)]).withColumn("n", F.lit(1)).withColumn("score", F.lit("s")).withColumn("doc", F.lit(2.0))
    now, none = odd, odd.limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        now, none = stage(spark, now, path), stage(spark, none, path)
        assert now.columns == odd.columns == none.columns
    rows = [r.doc_id for r in now.collect()]
    assert len(rows) == len(set(rows)) and None in rows and none.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, none, path).count() == 0


def test_all_queries_are_registered():
    names = [n for n in entry.queries() if n == "pipeline" or n.startswith("op")]
    assert len([n for n in names if n in load()[0]]) == 13 and "pipeline" in names
    assert {n.split("_")[0] for n in load()[0]} == {f"op{i}" for i in range(1, 14)}


def test_copies_stage_moves_no_texts(spark, stored, monkeypatch):
    from rosterlake.llm import jaccard
    read, old = [], jaccard._texts_of
    monkeypatch.setattr(jaccard, "_texts_of", lambda docs, ids: read.append(ids.count()) or old(docs, ids))
    docs = test_jaccard.passages(120)
    path = stored(docs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16")
    try:
        kept = dict(corpus_pipeline.STAGES)["n-gram jaccard join"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(120))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert read and max(read) <= 24     # the near copies and their originals, not every document with the passage
