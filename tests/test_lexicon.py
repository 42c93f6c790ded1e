"""Dictionaries as tables: the automaton against the literal form."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import lexicon, match
from rosterlake.sources import landed


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def texts(spark, n, seed=1):
    rng = random.Random(seed)
    parts = ["the", "THE", "other", "he", "ushers", "a-b", "x_y", "3.5", "été", "token", "Token_", "日本", " ", ".", "_", "\n", "İz"]
    made = [(k, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30)))) for k in range(n)]
    return spark.createDataFrame(made + [(-1, None), (-2, "")], "id long, text string")


WORDS = ["he", "she", "The", "her", "hers", "a-b", "x_y", "3.5", "ÉTÉ", "token", "token_", "日", "b x", "_", "absent", "th"]


@pytest.mark.parametrize("kind", ["contains", "word"])
@pytest.mark.parametrize("part_bytes", [1 << 20, 7])
def test_equals_the_literal_form(spark, kind, part_bytes):
    df = texts(spark, 200)
    dictionary = spark.createDataFrame([(w, float(i)) for i, w in enumerate(WORDS)], "word string, points double")
    got = lexicon.long_hits(df, "id", "text", dictionary, match=kind, part_bytes=part_bytes)
    want = match.long_hits(df, "id", "text", [match.Term(w, float(i)) for i, w in enumerate(WORDS)], kind).drop("label")
    assert got.columns == want.columns and rows(got) == rows(want)


def test_odd_dictionaries(spark):
    df = texts(spark, 20)
    schema = "word string"
    assert rows(lexicon.long_hits(df, "id", "text", spark.createDataFrame([], schema))) == []
    assert rows(lexicon.long_hits(df, "id", "text", spark.createDataFrame([(None,), ("",)], schema))) == []
    one, two = (spark.createDataFrame([("the",)] * n, schema) for n in (1, 2))
    assert rows(lexicon.hits(df, "id", F.col("text"), two)) == rows(lexicon.hits(df, "id", F.col("text"), one))
    assert rows(lexicon.long_hits(df.limit(0), "id", "text", one)) == []


def test_any_column_names(spark):
    df = texts(spark, 30).withColumns({c: F.lit("z") for c in ("key", "words", "low", "entry", "word")})
    dictionary = spark.createDataFrame([("the", "z")], "word string, low string")
    got = lexicon.long_hits(df, ["id", "key"], "text", dictionary)
    assert got.columns == ["id", "key", "word", "low"] and got.count() == df.filter("contains(lower(text), 'the')").count() > 0


def test_first_hit_by_position(spark):
    df = texts(spark, 60)
    dictionary = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS)], "word string, at int")
    want = df.select("id", match.first_hit("text", match.terms(WORDS))["word"].alias("word")).filter("word is not null")
    assert rows(lexicon.first_hits(df, "id", "text", dictionary, "at").select("id", "word")) == rows(want)


def test_time_does_not_follow_the_number_of_words(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(200_000)}
    docs = [" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(200)) for _ in range(1500)]
    few, many = lexicon.automaton(sorted(made)[::10]), lexicon.automaton(sorted(made))

    def took(built):
        best = 9e9
        for _ in range(3):
            t = time.process_time()
            for text in docs:
                lexicon.found_in(text, built, False)
            best = min(best, time.process_time() - t)
        return best
    assert took(many) < 4 * took(few)     # ten times as many words
    text = docs[0]
    assert lexicon.found_in(text, many, False) == sorted(w for w in made if w in text)


def test_many_words_in_parts(spark):
    """200 000 words, more than one automaton holds."""
    words = spark.range(200_000).select(F.concat(F.lit("w"), F.hex("id"), F.lit("q")).alias("word"))
    docs = spark.range(300).select("id", F.concat(F.lit("see W"), F.hex(F.col("id") * 997), F.lit("Q here")).alias("text"))
    total = words.agg(F.sum(F.length("word"))).first()[0]
    assert lexicon.parts_of(words.select(F.lower("word").alias("low")), total // 3) >= 3
    got = lexicon.long_hits(docs, "id", "text", words, match="word", part_bytes=total // 3)
    assert rows(got) == sorted((i, f"w{i * 997:X}q") for i in range(300) if i * 997 < 200_000)


def test_domains_of_urls(spark):
    df = spark.createDataFrame([(1, ["https://data.example.org/x", "http://EXAMPLE.org", "ftp://other"]), (2, None), (3, [None])], "id long, urls array<string>")
    domains = spark.createDataFrame([("data.example.org", 1), ("example.org", 2)], "domain string, at int")
    first = rows(lexicon.url_domains(df, "id", "urls", domains, "at"))
    assert first == [(1, "http://EXAMPLE.org", "example.org"), (1, "https://data.example.org/x", "data.example.org")]
    assert len(rows(lexicon.url_domains(df, "id", "urls", domains))) == 3


def test_dictionary_files(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.json").write_text('{"one": ["x", "y"]}\n{"one": ["z", null], "two": []}\n')
    defaults = {"one": ("d",), "two": ("e", "f")}
    assert rows(landed.signals_table(spark, str(folder), defaults)) == [("one", "x"), ("one", "y"), ("one", "z"), ("two", "e"), ("two", "f")]
    pretty = tmp_path / "pretty.json"
    pretty.write_text(json.dumps({"two": ["k"]}, indent=2))
    assert rows(landed.signals_table(spark, str(pretty), defaults, multiline=True)) == [("one", "d"), ("two", "k")]
