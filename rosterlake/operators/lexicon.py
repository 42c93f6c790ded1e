"""Dictionaries that are tables: every word found in one pass over a text, however many words there are.

The words become an Aho-Corasick automaton (a trie with failure and output links), so the work on a text is its length
plus its hits.  A dictionary is measured first.  Up to ``PART_BYTES`` of words it is one automaton, built once and
broadcast; a larger one is dealt by a hash of the word into parts of that size, each an automaton with a pass of its own,
so neither the driver nor a task ever holds more than one part's words.

Text and words are compared in lower case, as ``match`` does with dictionaries that are literals of the plan; both
forms give the same hits.  Null texts, null words and empty words hit nothing; a word listed twice counts once.
"""

import functools
import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.arrays import explode_rows

PART_BYTES = 3 << 20      # of words in one automaton, which takes about thirty times as much memory
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def automaton(words) -> ahocorasick.Automaton:
    """Automaton whose values are the words themselves."""
    built = ahocorasick.Automaton()
    for word in words:
        built.add_word(word, word)
    built.make_automaton()
    return built


def found_in(text: str, built, whole: bool) -> list:
    """Different words of the automaton in a text, sorted."""
    if not whole:
        return sorted({word for _, word in built.iter(text)})
    out, most = set(), len(text)
    for end, word in built.iter(text):
        if word in out or end + 1 < most and text[end + 1] in _WORD:
            continue
        start = end - len(word)
        if start < 0 or text[start] not in _WORD:
            out.add(word)
    return sorted(out)


def _scanner(shipped, whole: bool):
    def scan(batches):
        built = shipped.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lists = [None if t is None else found_in(t, built, whole) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lists, pa.list_(pa.string()))],
                                             names=[*batch.schema.names[:-1], "words"])
    return scan


def parts_of(words: DataFrame, part_bytes=PART_BYTES) -> int:
    """Parts that a table of lower-cased words needs."""
    total = words.agg(F.sum(F.octet_length("low"))).first()[0]
    return 0 if total is None else max(1, math.ceil(total / part_bytes))


def _lowered(dictionary: DataFrame, word: str) -> DataFrame:
    return dictionary.select(F.lower(F.col(word)).alias("low")).filter("low <> ''").distinct()


def hits(df: DataFrame, key, text: Column, dictionary: DataFrame, word="word", match="contains", part_bytes=PART_BYTES) -> DataFrame:
    """One row (key columns, ``low``) per row of ``df`` and different lower-cased word that its text contains.

    ``match='contains'`` is a substring test, ``'word'`` asks for ASCII word boundaries on both sides.
    """
    spark, keys = df.sparkSession, [key] if isinstance(key, str) else list(key)
    words = _lowered(dictionary, word)
    parts = parts_of(words, part_bytes)
    # key columns travel through Python as one struct, so their names may be any
    lowered = df.select(F.struct(*keys).alias("key"), F.lower(text).alias("text"))
    if not parts:
        return lowered.filter("false").select("key.*", F.lit("").alias("low"))
    schema = lowered.drop("text").schema.add("words", ArrayType(StringType()))
    passes = []
    for part in range(parts):
        own = words.filter(F.pmod(F.xxhash64("low"), F.lit(parts)) == part).toArrow()["low"].to_pylist()
        if not own:
            continue
        shipped = spark.sparkContext.broadcast(automaton(own))
        passes.append(explode_rows(lowered.mapInArrow(_scanner(shipped, match == "word"), schema), "key", F.col("words"), "low"))
    return functools.reduce(DataFrame.unionByName, passes).select("key.*", "low")


def _entries(df, key, text, dictionary, word, match, part_bytes=PART_BYTES) -> DataFrame:
    """(key, entry): key columns and dictionary row of every hit, as structs."""
    found = hits(df, key, F.expr(text), dictionary, word, match, part_bytes)
    keys = [key] if isinstance(key, str) else list(key)
    listed = dictionary.select(F.struct(*dictionary.columns).alias("entry"), F.lower(F.col(word)).alias("low"))
    return found.select(F.struct(*keys).alias("key"), "low").join(listed, "low").select("key", "entry")


def long_hits(df: DataFrame, key, text: str, dictionary: DataFrame, word="word", match="contains", part_bytes=PART_BYTES) -> DataFrame:
    """One row per (row, dictionary row) hit: the key columns, then all columns of the dictionary."""
    return _entries(df, key, text, dictionary, word, match, part_bytes).select("key.*", "entry.*")


def first_hits(df: DataFrame, key, text: str, dictionary: DataFrame, position: str, word="word", match="contains") -> DataFrame:
    """The dictionary row of least ``position`` per row of ``df`` that has a hit."""
    best = F.min(F.struct(F.col("entry")[position], "entry")).alias("best")
    return _entries(df, key, text, dictionary, word, match).groupBy("key").agg(best).select("key.*", "best.entry.*")


def url_domains(df: DataFrame, key, urls: str, domains: DataFrame, position: str = None, domain="domain") -> DataFrame:
    """(key, url, domain): domains of a table found in an array column of URLs.

    With ``position`` only the first domain of each URL in that order, else all of them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    each = explode_rows(df, keys, F.expr(urls), "url", "_at")
    if position is None:
        return long_hits(each, [*keys, "_at", "url"], "url", domains.select(domain), domain).select(*keys, "url", domain)
    return first_hits(each, [*keys, "_at", "url"], "url", domains.select(domain, position), position, domain).select(*keys, "url", domain)
