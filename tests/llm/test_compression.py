"""Compression classifier: held-out accuracy, edge rows, what must not leak."""

import zlib

import pytest

from rosterlake.llm import compression
from rosterlake.llm.book import load

OP = load()[0]["op9_quality_classifier"]
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_ranking(spark, sf_dir):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = OP(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good = [r.score for r in rows if r.held_out and quality.get(r.doc_id) == 1]
    bad = [r.score for r in rows if r.held_out and quality.get(r.doc_id) == 0]
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert not pairs or sum(pairs) / len(pairs) >= 0.8


def corpus(n=60):
    docs = [(i, f"the house stands by the river and the garden number {i} is green " * 3) for i in range(n)]
    docs += [(1000 + i, f"### buy $$$ now %%% {i} *** cheap ### " * 4) for i in range(n)]
    return docs, [(i, int(i < 1000), 0) for i, _ in docs]


def test_edge_rows(spark, stored):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (None, docs[0][1]), (5002, "the house stands by the river " * 20_000), (5003, docs[60][1]), (5003, docs[60][1]),
             (5004, "\U0001f600é")]
    labels += [(5001, None, None), (None, 1, 0), (1, 0, 0), (1, 1, 0), (7777, 1, 0), (3, 1, 0), (5, 9, 0)]
    path = stored(docs, labels=spark.createDataFrame(labels, LABELS))
    rows = OP(spark, path).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert by[5000].score == by[5001].score and by[None].held_out
    assert by[5002].predicted == 1 and by[5003].predicted == 0
    assert all(by[i].predicted == (i < 1000) for i, _ in docs[:120])


def test_held_out_labels_teach_nothing(spark, docs_of):
    docs, labels = corpus()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    turned = [(i, 1 - q if held(i) else q, t) for i, q, t in labels]
    a, b = (sorted(compression.scores(docs_of(docs), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert a == b


def test_empty_tables_and_one_sort(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert compression.scores(docs_of([]), none).collect() == []
    assert [r.score for r in compression.scores(docs_of([(1, "a")]), none).collect()] == [1.0]
    only = spark.createDataFrame([(2, 0, 0), (1, 0, 0), (4, 0, 0)], LABELS)
    assert {r.score for r in compression.scores(docs_of([(1, "a"), (2, "b"), (4, "c")]), only).collect()} == {0.0}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_very_few_labels(n):
    scorer = compression.fit([b"good text here"] * n, [b"#### $$$$"] * n)
    score = scorer.score(__import__("numpy").array([compression.features_of(b"good text", *scorer.opened())]))
    assert 0 <= score[0] <= 1
