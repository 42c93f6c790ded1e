"""Source divergence audit: how the word use of every source differs from that of the others and of its language.

Texts become terms by one ``bytes.translate`` (A-Z lowered, every other ASCII byte that is no letter blanked), one
``bytes.split`` and a ``Counter`` per document.  Tasks add the documents' counters up per (lang, source) and hand
sparse rows (lang, source, term, occurrences, documents) to one shuffle by (lang, term).  A language keeps the terms
of at least ``least_docs`` of its documents.

* Null text, lang and source count as ''.  A text without terms adds none, but its (lang, source) group still occurs.
* Repeated rows are documents of their own.  An empty table gives an empty result.
* Of the input only ``text``, ``lang`` and ``source`` are read; other columns, whatever their names, are not.
* A text of any length is split block by block; what a task holds is bounded by ``ENTRIES``.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import in_arrow

UNIT = 1_000_000_000       # probabilities are counted in billionths
BLOCK = 1 << 20            # bytes of a text split at a time
ENTRIES = 400_000          # (group, term) entries that a task holds before it hands them on
TERMS = 512                # kept terms of a language that one block of the pair sums holds, about
TILE = 128                 # sources of a language compared at a time
TALLY = "lang string, source string, term string, n long, docs long"

FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> Counter:
    """Terms of one text and how often each occurs."""
    flat = text.translate(FLAT)
    if len(flat) <= BLOCK:
        return Counter(flat.split())
    counts, at = Counter(), 0
    while at < len(flat):
        end = flat.find(b" ", at + BLOCK)
        end = len(flat) if end < 0 else end
        counts.update(flat[at:end].split())
        at = end
    return counts


def _rows(seen: dict):
    """Record batch of all that ``seen`` holds; the empty term marks a group that occurs."""
    langs, sources, terms, n, docs = [], [], [], [], []
    for (lang, source), (counts, holders) in seen.items():
        size = len(counts) + 1
        langs.append((lang, size))
        sources.append((source, size))
        terms.append(b"")
        terms.extend(counts)
        n.append(0)
        n.extend(counts.values())
        docs.append(0)
        docs.extend(map(holders.__getitem__, counts))

    def repeated(pairs):
        index = np.repeat(np.arange(len(pairs)), [size for _, size in pairs])
        return pa.array([value for value, _ in pairs], pa.string()).take(pa.array(index))
    return pa.RecordBatch.from_arrays(
        [repeated(langs), repeated(sources), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
         pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _tally(batches):
    seen, held = {}, 0
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for text, lang, source in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            counts, holders = seen.setdefault((lang, source), (Counter(), Counter()))
            found = terms_of(text.as_py())
            held -= len(counts)
            counts.update(found)
            holders.update(found.keys())
            held += len(counts)
            if held >= ENTRIES:
                yield _rows(seen)
                seen, held = {}, 0
    if seen:
        yield _rows(seen)


def tallies(docs: DataFrame) -> DataFrame:
    """Per (lang, source, term): occurrences ``n`` and documents ``docs``; the term '' stands for the group itself."""
    plain = docs.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
                          for name in ("text", "lang", "source")])
    rows = in_arrow(plain, _tally, TALLY).repartition("lang", "term")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least_docs=3) -> DataFrame:
    """``tallies`` of the terms that a language keeps, with the language's count ``all_n``.

    ``lead`` is 1 in one row of every term of a language; groups stay as rows of the term '' with no occurrences.
    """
    term = Window.partitionBy("lang", "term")
    rows = (tallies(docs).withColumn("holders", F.sum("docs").over(term)).withColumn("all_n", F.sum("n").over(term))
            .withColumn("lead", (F.row_number().over(term.orderBy("source")) == 1).cast("long")))
    return rows.filter((F.col("term") == "") | (F.col("holders") >= least_docs)).select(
        "lang", "source", "term", "n", "all_n", F.when(F.col("term") == "", 0).otherwise(F.col("lead")).alias("lead"))


def _share(count, total, kinds):
    """1 + floor(UNIT * (count + 1) / (total + kinds)), exact beyond 64 bits."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + kinds).cast("decimal(20,0)")) + 1


def _gap(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


def _groups(kept: DataFrame) -> DataFrame:
    """Every (lang, source): its place ``at`` in the language, count ``total``, share ``p0`` of a term it lacks."""
    of_lang = kept.groupBy("lang").agg(F.sum("lead").alias("kinds"), F.sum("n").alias("all_total"),
                                       F.count_if(F.col("term") == "").alias("sources"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(of_lang, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return groups.withColumn("at", place).withColumn(
        "p0", F.when(F.col("kinds") > 0, _share(F.lit(0), F.col("total"), F.col("kinds"))))


PAIR_SUMS = "lang string, a int, b int, excess long"


def _pair_sums(table: pa.Table) -> pa.Table:
    """Gaps between all sources of two tiles over one block of terms, beyond those of terms that neither side has."""
    at = table["at"].to_numpy()
    sources, first, row = np.unique(at, return_index=True, return_inverse=True)
    p0 = table["p0"].to_numpy()[first]
    term = table["term"].combine_chunks().dictionary_encode()
    names = term.dictionary.to_pylist()
    blank = names.index("") if "" in names else -1
    codes = term.indices.to_numpy()
    real = codes != blank
    shares = np.repeat(p0[:, None], len(names), axis=1)
    shares[row[real], codes[real]] = table["p"].to_numpy()[real]
    shares = np.delete(shares, blank, axis=1) if blank >= 0 else shares
    shares = shares[:, (shares != p0[:, None]).any(axis=0)]
    tile, (lo, hi) = sources // TILE, (table["lo"][0].as_py(), table["hi"][0].as_py())
    a, b, excess = [], [], []
    for i, source in enumerate(sources):
        others = np.flatnonzero(tile == (hi if tile[i] == lo else lo))
        others = others[others != i]
        gaps = (shares[i] - shares[others]) ** 2 // shares[others]
        rest = (p0[i] - p0[others]) ** 2 // p0[others]
        a.append(np.full(len(others), source))
        b.append(sources[others])
        excess.append((gaps - rest[:, None]).sum(axis=1))
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    a = join(a)
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.int32()),
                     "b": pa.array(join(b), pa.int32()), "excess": pa.array(join(excess), pa.int64())})


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Value of every ordered pair of sources of a language."""
    blocks = F.ceil(F.col("kinds") / TERMS).cast("int")
    here = F.when(F.col("term") == "", F.sequence(F.lit(0), blocks - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("term"), blocks).cast("int")))
    tile, last = F.floor(F.col("at") / TILE).cast("int"), F.floor((F.col("sources") - 1) / TILE).cast("int")
    dealt = (shares
             .select("lang", "at", "term", "p", "p0", tile.alias("tile"),
                     F.explode(F.sequence(F.lit(0), last)).alias("other"), here.alias("blocks"))
             .select("lang", "at", "term", "p", "p0", F.explode("blocks").alias("block"),
                     F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")))
    sums = (dealt.groupBy("lang", "block", "lo", "hi").applyInArrow(_pair_sums, PAIR_SUMS)
            .groupBy("lang", "a", "b").agg(F.sum("excess").alias("excess")))
    one = groups.select("lang", "source", F.col("at").alias("a"), F.col("p0").alias("pa"), "kinds")
    two = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("p0").alias("pb"))
    both = one.join(two, "lang").filter(F.col("a") != F.col("b")).join(sums, ["lang", "a", "b"], "left")
    base = F.when(F.col("kinds") > 0, F.col("kinds") * _gap(F.col("pa"), F.col("pb"))).otherwise(0)
    return both.select("lang", "source", F.lit("pair").alias("part"), "item",
                       (base + F.coalesce("excess", F.lit(0))).alias("value"))


def divergences(docs: DataFrame, least_docs=3, top_terms=200) -> DataFrame:
    """(lang, source, part, item, value, rank): gaps to every other source, and the terms a source uses more than its language.

    A gap of shares p and q is floor((p - q) ** 2 / q); part ``pair`` sums it over all kept terms, part ``term`` keeps
    the first ``top_terms`` of a group.
    """
    kept = materialise(kept_terms(docs, least_docs), "terms")
    groups = materialise(_groups(kept), "sources")
    shares = kept.join(groups, ["lang", "source"]).filter(F.col("kinds") > 0).withColumn(
        "p", _share(F.col("n"), F.col("total"), F.col("kinds")))
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(shares, groups).withColumn(
        "rank", F.row_number().over(ordered))
    q = _share(F.col("all_n"), F.col("all_total"), F.col("kinds"))
    terms = (shares.filter(F.col("n") > 0).withColumn("q", q).filter(F.col("p") > F.col("q"))
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     _gap(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= top_terms))
    return pairs.unionByName(terms)
