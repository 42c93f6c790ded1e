"""Language ID: held-out accuracy, the random field against enumeration, edge rows."""

import itertools
import zlib

import numpy as np
import pytest

from rosterlake.llm import crf, language
from rosterlake.llm.book import load

OP = load()[0]["op8_language_id"]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = OP(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(langs)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    checked = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in checked) >= 0.95 * len(checked)


def small_corpus():
    texts = {"en": "the house and the garden with water", "de": "das haus und der garten mit wasser", "xx": "qo zu lika pora"}
    return [(i, t + f" n{i}", lang, None, None) for i, (lang, t) in enumerate(list(texts.items()) * 12)]


def test_edge_rows(spark, stored):
    docs = small_corpus() + [(100, None, "en"), (101, "", "en"), (102, "12 34 !!", "de"), (None, "das haus", None), (103, "the garden", None),
                             (104, "das haus und der garten mit " * 30_000, None), (105, "中文 only", None), (103, "the garden", None),
                             (106, "İß \U0001f600 wasser", "de")]
    got = {(r.doc_id, i): r for i, r in enumerate(OP(spark, stored(docs)).collect())}
    by = {}
    for (id_, _), r in got.items():
        by.setdefault(id_, []).append(r)
    assert len(got) == len(docs)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (100, 101, 102))
    assert by[104][0].lang_pred == "de" and by[103][0].lang_pred == "en" and by[None][0].lang_pred == "de"
    assert by[None][0].held_out and by[103][0] == by[103][1]
    assert by[105][0].lang_pred in ("en", "de", "xx")


def test_empty_and_unlabelled(spark, docs_of):
    assert language.predictions(docs_of([])).collect() == []
    got = language.predictions(docs_of([(1, "the house")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_held_out_rows_teach_nothing(docs_of):
    docs = [r for r in small_corpus()]
    other = [(i, t, "zz" if held_out(i) else lang) for i, t, lang, _, _ in docs]
    a = {r.doc_id: r.lang_pred for r in language.predictions(docs_of(docs)).collect()}
    assert a == {r.doc_id: r.lang_pred for r in language.predictions(docs_of(other)).collect()}


def test_accepted_keeps_columns(spark, docs_of):
    from pyspark.sql import functions as F
    docs = docs_of(small_corpus() + [(100, None, "en"), (102, "12 34", "de")]).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 36


@pytest.fixture
def model():
    rng = np.random.default_rng(1)
    return crf.Model(("a", "b", "c"), None, rng.normal(size=(3, 3)), rng.normal(size=3))


def paths(model, scores):
    for path in itertools.product(range(3), repeat=len(scores)):
        total = model.start[path[0]] + sum(scores[t, y] for t, y in enumerate(path))
        yield path, total + sum(model.transitions[x, y] for x, y in zip(path, path[1:]))


def test_field_against_enumeration(model):
    rng = np.random.default_rng(2)
    lengths = [1, 4, 0, 2, 5, 3]
    edges = np.concatenate(([0], np.cumsum(lengths)))
    scores = rng.normal(size=(edges[-1], 3)).astype(np.float32)
    tags, marginal = crf.viterbi(model, scores, edges), crf.forward_backward(model, scores, edges)
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        all_ = list(paths(model, scores[a:b].astype(float)))
        assert tuple(tags[a:b]) == max(all_, key=lambda p: p[1])[0]
        weight = np.exp([t for _, t in all_])
        for t in range(b - a):
            want = [weight[[p[t] == y for p, _ in all_]].sum() / weight.sum() for y in range(3)]
            assert np.allclose(marginal[a + t], want, atol=1e-5)


def test_segments_cover_everything(monkeypatch):
    monkeypatch.setattr(crf, "SEGMENT", 4)
    got = crf.segments(np.array([0, 0, 9, 9, 13, 14]))
    assert got.tolist() == [0, 4, 8, 9, 13, 14]


def test_transitions_are_learned():
    sequences = [(["x"] * 6, [0, 1, 0, 1, 0, 1], ()) for _ in range(20)]
    got = crf.train(sequences, ("a", "b"), lambda w: ["w=" + w], neighbours=False, rounds=60)
    assert got.transitions[0, 1] > got.transitions[0, 0] and got.transitions[1, 0] > got.transitions[1, 1]


def by_language(spark, sf_dir):
    out = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang is not null and n_chars > 400").collect():
        if held_out(r.doc_id):
            out.setdefault(r.lang, []).append(language.letter_words(r.text)[:120])
    return out


def test_switched_text_gives_its_mixture(spark, docs_of, sf_dir):
    held = by_language(spark, sf_dir)
    a, b = sorted(held, key=lambda lang: -len(held[lang]))[:2]
    mixed = [(i, " ".join(x[:30] + y[:10] + x[30:50])) for i, (x, y) in enumerate(zip(held[a], held[b]))][:20]
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for r in language.labelled(docs_of(mixed), model).collect():
        share = {m.lang: m.share for m in r.mixture}
        assert abs(sum(share.values()) - 1) < 1e-3 and set(share) == {*held, "und"}
        assert abs(share[a] - 5 / 6) < 0.12 and abs(share[b] - 1 / 6) < 0.12
        assert r.lang_pred == a and r.score == share[a]


def test_unknown_text_is_not_accepted(spark, docs_of, sf_dir):
    import random
    rng = random.Random(3)
    held = by_language(spark, sf_dir)
    foreign = sorted(held, key=lambda lang: len(held[lang]))[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").filter(f"lang <> '{foreign}'")
    known = [" ".join(w) for lang, texts in held.items() if lang != foreign for w in texts][:60]
    strange = [" ".join(language.shuffled(w, rng) for w in t.split()) for t in known]
    other = [" ".join(w) for w in held[foreign]]
    rows = [(10_000_000 + 1_000_000 * k + i, t, None) for k, texts in enumerate((known, strange, other)) for i, t in enumerate(texts)]
    kept = [r.doc_id // 1_000_000 - 10 for r in language.accepted(docs.unionByName(docs_of(rows))).filter("doc_id >= 10000000").collect()]
    assert kept.count(0) >= 0.98 * len(known) and kept.count(1) == 0 and kept.count(2) <= 0.2 * len(other)


def test_letters_only():
    assert language.letter_words("½ ² Ⅷ ① 12 _ 四") == ["四"]
    assert language.letter_words("e\u0301te\u0301 naïve Straße x²y") == ["e\u0301te\u0301", "naïve", "straße", "x", "y"]
    assert language.letter_words("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and language.letter_words("\u0301 a") == ["a"]


def test_numerals_have_no_language(docs_of):
    docs = docs_of([(k, "the cat and the dog went out", "en") for k in range(40)] + [(k, "der Hund und die Katze sind da", "de") for k in range(40, 80)]
                   + [(100, "½ ² Ⅷ ①")])
    got = {r.doc_id: r for r in language.predictions(docs).collect()}
    assert got[100].lang_pred == "und" and got[100].score == 0


def test_accepted_keeps_clashing_columns(docs_of):
    from pyspark.sql import functions as F
    docs = docs_of([(k, "the cat and the dog went out", "en") for k in range(40)] + [(k, "der Hund und die Katze sind da", "de") for k in range(40, 80)])
    names = ("lang_pred", "score", "mixture", "__score", "LANG_PRED_")
    wide = docs.withColumns({c: F.lit("z") for c in names})
    got = language.accepted(wide)
    assert got.columns == wide.columns and got.count() == 80


def test_both_patterns_agree_on_latin_1():
    import random
    rng = random.Random(3)
    chars = [chr(c) for c in range(256)]
    for _ in range(2000):
        text = "".join(rng.choices(chars, k=30)).lower()
        assert language._LATIN.findall(text) == language._LETTERS.findall(text)
