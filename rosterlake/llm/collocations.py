"""Phrase collocation mining by Toivonen's method: a sample proposes, a full pass counts, failures of the border go on.

Texts fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words at blanks and tabs, A-Z lowered; a phrase is up to
``LONGEST`` words in a row of one piece, and everything is per language.

1. A sample, ``SHARE`` of all rows by a hash of the id, is mined for phrases of a lowered support.  They are closed
   downward: with a phrase its parts are proposed.
2. One pass over all texts counts exactly all words and every longer phrase whose first and whose last words, one less,
   are proposed.  These are the proposed phrases and their negative border.
3. A phrase that reaches the support without being proposed is a failure of the border: longer ones around it were not
   counted.  It is proposed, and another pass counts only what its proposal adds; until none fails.

Proposals travel as a bit filter of at most ``MOST_BITS`` bits, which never misses one; phrases let through by mistake are
counted too, and a filter too full for its phrases costs time, not results.  Phrases are counted under 62-bit hashes, and
each count brings a place, a hash of one row that holds the phrase; a last pass takes the words of the frequent phrases
from the rows at their places.  Counts leave a task added up, and one shuffle by phrase follows.

* A null text is empty, a null lang is ``und``.  Repeated rows count again.  An empty table gives an empty result.
* Only ``doc_id``, ``text`` and ``lang`` are read; other columns, whatever their names, are not.
* Texts are whole; long ones are cut between pieces only.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import SLICE_BYTES, WordHash, byte_set, bytes_of, in_arrow, mix, spans, windows
from .sampling import PARTS, part

LONGEST = 4
SHARE = 1 / 8           # of the rows, mined for proposals
EASE = 0.6              # of the support expected in the sample
MOST_BITS = 27          # log2 of the bits of a filter
LEAST_BITS = 16
HELD = 1 << 21          # phrase keys that a task holds before it adds them up
KEPT = 1 << 22          # different keys that a task holds before it hands them on
RECENT = 21             # log2 of the slots in which a task notes phrases it has named
PLACES = 20             # log2 of the places that rows are dealt to; one place of each phrase names it

BLANK = byte_set(b" \t")
STOP = byte_set(b".,;:!?\n\x0b\x0c\r")
GAP = BLANK | STOP
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---- words and keys of texts ------------------------------------------------------------------------------------------

def lang_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def cut(data: np.ndarray, offsets: np.ndarray):
    """Borders of rows, and the row of each stretch between them; rows beyond a slice are cut after stops."""
    sizes = np.diff(offsets)
    if not (sizes > SLICE_BYTES).any():
        return offsets, np.arange(len(sizes))
    borders, rows = [0], []
    for row, (start, end) in enumerate(zip(offsets[:-1], offsets[1:])):
        stops = np.flatnonzero(STOP[data[start:end]]) + start + 1 if end - start > SLICE_BYTES else []
        at = start
        while end - at > SLICE_BYTES and len(stops):
            k = int(np.searchsorted(stops, at + SLICE_BYTES, side="right")) - 1
            k = k if k >= 0 and stops[k] > at else int(np.searchsorted(stops, at, side="right"))
            if k >= len(stops):
                break
            at = int(stops[k])
            borders.append(at)
            rows.append(row)
        borders.append(end)
        rows.append(row)
    return np.array(borders, np.int64), np.array(rows, np.int64)


class Stretch:
    """Words of some rows, and the keys of their phrases."""

    def __init__(self, data, offsets, langs, places, hasher):
        self.data, self.places = data, places
        self.starts, self.ends, counts = spans(data, offsets, GAP)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.piece = np.cumsum(STOP[data], dtype=np.int64)[self.starts] + self.row if len(self.starts) else np.zeros(0, np.int64)
        self.hashes, self.langs = hasher(data, self.starts, self.ends), langs
        self._keys = {}

    def keys(self, size: int) -> np.ndarray:
        """Keys of the phrases of ``size`` words that begin at each word; the two low bits hold the size."""
        if size not in self._keys:
            self._keys[size] = keys_of(self.hashes, self.langs[self.row], size)
        return self._keys[size]

    def inside(self, size: int) -> np.ndarray:
        """Whether the phrase of ``size`` words from each word lies in one piece."""
        n = max(len(self.piece) - size + 1, 0)
        return self.piece[:n] == self.piece[size - 1:size - 1 + n]


def keys_of(hashes: np.ndarray, langs: np.ndarray, size: int) -> np.ndarray:
    runs = windows(hashes, size)
    return (mix(runs ^ langs[:len(runs)]) & ~np.uint64(3)) | np.uint64(size - 1)


def stretches(batches):
    """Stretches of about ``SLICE_BYTES`` of (text, lang, place) batches, with the names of the languages."""
    hasher = WordHash(lower=True)
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(1).to_pylist()
        codes = {name: lang_code(name) for name in set(names)}
        langs, places = np.array([codes[name] for name in names], np.uint64), batch.column(2).to_numpy()
        data, offsets = bytes_of(batch.column(0))
        borders, rows = cut(data, offsets)
        at = 0
        while at < len(rows):
            stop = min(max(int(np.searchsorted(borders, borders[at] + SLICE_BYTES, side="right")) - 1, at + 1), len(rows))
            own = borders[at:stop + 1]
            here = rows[at:stop]
            yield Stretch(data[own[0]:own[-1]], own - own[0], langs[here], places[here], hasher), [names[r] for r in here]
            at = stop


# ---- filters ----------------------------------------------------------------------------------------------------------

def admitted(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter admits each key: two bits, taken from the key's highest."""
    size = np.uint64(int(len(bits) * 8).bit_length() - 1)
    one = keys >> (np.uint64(64) - size)
    two = (keys >> (np.uint64(64) - size - size)) & ((np.uint64(1) << size) - np.uint64(1))
    probe = lambda at: (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return (probe(one) & probe(two)).astype(bool)


def filter_size(keys: int, bits_per_key=16) -> int:
    return min(max(LEAST_BITS, (max(keys, 1) * bits_per_key - 1).bit_length()), MOST_BITS)


def filter_of(keys: DataFrame, size: int) -> np.ndarray:
    """Bit filter of a table's ``key``; 2 ** size bits reach the driver, however many keys there are."""
    top = F.shiftrightunsigned("key", 64 - size)
    low = F.shiftrightunsigned("key", 64 - 2 * size).bitwiseAND(F.lit((1 << size) - 1))
    at = keys.select(F.explode(F.array(top, low)).alias("at"))
    words = at.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


# ---- counting ---------------------------------------------------------------------------------------------------------

def added(keys: np.ndarray, counts: np.ndarray, places: np.ndarray):
    """Different keys, their counts added up, and one of the places of each."""
    order = np.argsort(keys)
    keys, counts, places = keys[order], counts[order], places[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts, places[first]


class Sums:
    """Adds up keys; hands on what it holds when that grows beyond ``KEPT``."""

    def __init__(self):
        self.fresh, self.size, self.parts = [], 0, []

    def take(self, keys: np.ndarray, places: np.ndarray):
        self.fresh.append((keys, np.ones(len(keys), np.int64), places))
        self.size += len(keys)
        if self.size >= HELD:
            self._fold()
            if sum(len(k) for k, _, _ in self.parts) > KEPT:
                self.parts = [added(*map(np.concatenate, zip(*self.parts)))]
                if len(self.parts[0][0]) > KEPT // 2:
                    yield from self.rest()

    def _fold(self):
        if self.fresh:
            self.parts.append(added(*map(np.concatenate, zip(*self.fresh))))
        self.fresh, self.size = [], 0

    def rest(self):
        self._fold()
        if self.parts:
            keys, counts, places = added(*map(np.concatenate, zip(*self.parts)))
            self.parts = []
            for at in range(0, len(keys), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part].view(np.int64)), pa.array(counts[part], pa.int64()), pa.array(places[part], pa.int32())],
                    names=["key", "n", "place"])


def due(stretch: Stretch, bits, before):
    """(keys, rows) to count: all phrases without filters; else what ``bits`` admits by its two parts and ``before`` did not."""
    if bits is None:
        for size in range(1, LONGEST + 1):
            at = np.flatnonzero(stretch.inside(size))
            yield stretch.keys(size)[at], stretch.row[at]
        return
    words = stretch.keys(1)
    if before is None:
        yield words, stretch.row
    now = admitted(bits, words)
    old = admitted(before, words) if before is not None else None
    for size in range(2, LONGEST + 1):
        inside = stretch.inside(size)
        n = len(inside)
        open_ = now[:n] & now[1:n + 1] & inside
        done = old[:n] & old[1:n + 1] & inside if old is not None else np.zeros(n, bool)
        keys = stretch.keys(size)
        at = np.flatnonzero(open_ & ~done)
        yield keys[at], stretch.row[at]
        if size < LONGEST:  # proposals are closed downward: only phrases around admitted parts can be admitted
            at = np.flatnonzero(open_)
            now = np.zeros(n, bool)
            now[at] = admitted(bits, keys[at])
            if old is not None:
                at = np.flatnonzero(done)
                old = np.zeros(n, bool)
                old[at] = admitted(before, keys[at])


def _counted(bits, before):
    def counted(batches):
        sums = Sums()
        now, old = (None if b is None else b.value for b in (bits, before))
        for stretch, _ in stretches(batches):
            for keys, rows in due(stretch, now, old):
                yield from sums.take(keys, stretch.places[rows])
        yield from sums.rest()
    return counted


def counts(texts: DataFrame, least: int, bits=None, before=None) -> DataFrame:
    """(key, n, place) of the phrases counted at least ``least`` times; the filters are broadcast variables."""
    rows = in_arrow(texts, _counted(bits, before), "key long, n long, place int").repartition("key")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("place").alias("place")).filter(F.col("n") >= least)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1 << PLACES)).cast("int").alias("place"))


def frequent(docs: DataFrame, support=30, share=SHARE, passes: list = None) -> DataFrame:
    """(key, n, place) of all phrases of up to ``LONGEST`` words that occur ``support`` times in a language, written.

    ``passes`` gets, for each full pass, the phrases proposed for it.
    """
    spark, texts = docs.sparkSession, _texts(docs)
    chosen = docs.filter(part(F.col("doc_id"), F.lit(29)) < int(PARTS * share) + 1)
    low = max(1, int(support * share * EASE))
    proposed = materialise(counts(_texts(chosen), low), "proposed")
    bits, before, found = None, None, None
    size = filter_size(proposed.count())
    fresh, shared = proposed, []
    while True:
        more = filter_of(fresh.filter(F.col("key").bitwiseAND(F.lit(3)) < LONGEST - 1), size)
        now = more if bits is None else more | bits.value
        if bits is not None and (now == bits.value).all():
            break
        before, bits = bits, spark.sparkContext.broadcast(now)
        shared.append(bits)
        if passes is not None:
            passes.append(fresh.count())
        new = materialise(counts(texts, support, bits, before), "counted")
        found = new if found is None else found.unionByName(new)
        fresh = materialise(new.join(proposed.select("key"), "key", "left_anti").select("key", "n", "place"), "failed")
        proposed = proposed.unionByName(fresh)
    for variable in shared:
        variable.unpersist()
    return found


# ---- words of the frequent phrases --------------------------------------------------------------------------------------

def placed(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys of phrases at places, which differ from place to place in the bits of both probes."""
    places = places.astype(np.uint64)
    return keys ^ (places << np.uint64(64 - PLACES)) ^ (places << np.uint64(17))


def _placed(found: DataFrame) -> DataFrame:
    place = F.col("place").cast("long")
    return found.select(F.col("key").bitwiseXOR(F.shiftleft(place, 64 - PLACES)).bitwiseXOR(F.shiftleft(place, 17)).alias("key"))


def _named(bits):
    def named(batches):
        now, words = bits.value, {}
        recent = np.zeros(1 << RECENT, np.uint64)  # a phrase that another has driven out is named again
        for stretch, names in stretches(batches):
            for name, n in zip(names, np.bincount(stretch.row, minlength=len(names)).tolist()):
                words[name] = words.get(name, 0) + n
            lower = stretch.data.tobytes().translate(LOWER)
            for size in range(2, LONGEST + 1):
                keys, at = stretch.keys(size), np.flatnonzero(stretch.inside(size))
                slot = (keys[at] >> np.uint64(2)) & np.uint64((1 << RECENT) - 1)
                fresh = recent[slot] != keys[at]
                at, slot = at[fresh], slot[fresh]
                there = admitted(now, placed(keys[at], stretch.places[stretch.row[at]]))
                at, slot = at[there], slot[there]
                recent[slot] = keys[at]
                found, first = np.unique(keys[at], return_index=True)
                at = at[first]
                phrases = [b" ".join([lower[a:b] for a, b in zip(stretch.starts[i:i + size].tolist(), stretch.ends[i:i + size].tolist())])
                           for i in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array([names[r] for r in stretch.row[at].tolist()], pa.string()),
                     pa.array(phrases, pa.binary()).cast(pa.string()), pa.nulls(len(found), pa.int64())],
                    names=["key", "lang", "phrase", "n"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.nulls(len(words), pa.string()),
             pa.array(list(words.values()), pa.int64())], names=["key", "lang", "phrase", "n"])
    return named


PARTED = "key long, lang string, phrase string, a long, cuts array<struct<k:int,first:long,rest:long>>, inner array<long>"


def _parted(batches):
    """Adds the keys of the two parts of every cut, and those of the shorter phrases inside."""
    hasher = WordHash(lower=True)
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("lang").to_pylist()
        codes = {name: lang_code(name) for name in set(names)}
        data, offsets = bytes_of(batch.column("phrase"))
        starts, ends, sizes = spans(data, offsets, BLANK)
        langs = np.repeat(np.array([codes[name] for name in names], np.uint64), sizes)
        hashes = hasher(data, starts, ends)
        keys = [None] + [keys_of(hashes, langs, size).view(np.int64).tolist() for size in range(1, LONGEST)]
        cuts, inner = [], []
        for at, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
            cuts.append([{"k": k, "first": keys[k][at], "rest": keys[size - k][at + k]} for k in range(1, size)])
            inner.append([keys[k][at + j] for k in range(2, size) for j in range(size - k + 1)])
        schema = pa.list_(pa.struct([("k", pa.int32()), ("first", pa.int64()), ("rest", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("lang"), batch.column("phrase"), batch.column("a"), pa.array(cuts, schema),
             pa.array(inner, pa.list_(pa.int64()))], names=["key", "lang", "phrase", "a", "cuts", "inner"])


def collocations(docs: DataFrame, support=30, best=2000, share=SHARE, cover=80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``best`` phrases of every language.

    A phrase of 2 to 4 words that occurs a >= ``support`` times scores floor(2000000 a / (l + r)), l and r the counts
    of the two parts of its worst cut.  It goes if a longer one around it has ``cover`` percent of its count.
    """
    spark = docs.sparkSession
    found = frequent(docs, support, share)
    bits = spark.sparkContext.broadcast(filter_of(_placed(found), filter_size(found.count(), 64)))
    named = materialise(in_arrow(_texts(docs), _named(bits), "key long, lang string, phrase string, n long")
                        .groupBy("key", "lang").agg(F.min("phrase").alias("phrase"), F.sum("n").alias("n")), "named")
    words = named.filter(F.col("key").isNull()).select("lang", "n")
    phrases = named.filter(F.col("key").isNotNull()).select("key", "lang", "phrase").join(
        found.select("key", F.col("n").alias("a")), "key")
    parted = materialise(in_arrow(phrases, _parted, PARTED), "parted")

    covered = parted.select(F.explode("inner").alias("key"), "a").groupBy("key").agg(F.max("a").alias("around"))
    left = (parted.join(covered, "key", "left")
            .filter(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * cover)).drop("around", "inner"))
    cuts = left.select("key", "a", F.explode("cuts").alias("c")).select("key", "a", "c.k", "c.first", "c.rest")
    cuts = (cuts.join(found.select(F.col("key").alias("first"), F.col("n").alias("l")), "first")
            .join(found.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest"))
    wide = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    score = F.call_function("div", wide, (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    worst = cuts.groupBy("key").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))
    scored = left.select("key", "lang", "phrase", "a").join(worst, "key").select(
        "lang", "phrase", "a", "w.l", "w.r", "w.score").join(words, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
