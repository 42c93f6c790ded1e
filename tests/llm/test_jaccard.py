"""N-gram Jaccard join against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

from rosterlake.llm import jaccard
from rosterlake.llm.book import load

OP = load()[0]["op7_ngram_jaccard_join"]
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(docs):
    sets = {}
    for i, t in docs:
        sets.setdefault(shingles(t), []).append(i)
    keys = [k for k in sets if k]
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                parent[find(a)] = find(b)
    low = {}
    for k in keys:
        low[find(k)] = min(low.get(find(k), 1 << 60), min(sets[k]))
    return sorted((i, len(shingles(t)), low[find(shingles(t))] if shingles(t) else i) for i, t in docs)


def result(df):
    got = [tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()]
    return sorted(got, key=lambda r: (r[0] is None, r))


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    common = [word() for _ in range(25)]
    docs = []
    for _ in range(n):
        if docs and rng.random() < .6:
            words = list(rng.choice(docs))
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(rng.randint(1, 80))]
            if rng.random() < .5:
                at = rng.randrange(len(words) + 1)
                words[at:at] = common
        docs.append(words)
    return [(7 * i % 1009, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("crowd", [2, 200])
def test_matches_brute_force(docs_of, seed, crowd):
    docs = corpus(seed)
    got = jaccard.near_duplicates(docs_of(docs), crowd=crowd, rounds=1 + (seed + crowd) % 2)
    assert result(got) == brute(docs)


def test_given_table(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    assert result(OP(spark, sf_dir)) == brute(docs)


def test_edge_rows(spark, stored):
    text = "One two three four five six seven"
    long_ = " ".join(f"w{i}" for i in range(60_000))
    docs = [(9, text), (4, text.lower().replace(" ", "\t\n")), (5, None), (6, " \n"), (7, "a b"), (8, "A\x0bb"), (None, text),
            (3, long_), (11, long_ + " more"), (12, "nbsp joins words"), (9, text)]
    got = result(OP(spark, stored(docs)))
    want = brute([d for d in docs if d[0] is not None])
    assert [r for r in got if r[0] is not None] == want
    assert [r for r in got if r[0] is None] == [(None, 3, None)]


def test_empty_and_extra_columns(spark, docs_of):
    assert result(jaccard.near_duplicates(docs_of([]))) == []
    from pyspark.sql import functions as F
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "x"), (3, "z")])
    for name in ("n", "print", "prefix", "doc", "component_id", "h", "count"):
        docs = docs.withColumn(name, F.lit(1))
    assert result(jaccard.near_duplicates(docs)) == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 1, 3), (None, 1, None)]
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    twice = docs_of([(1, "a b c d e f"), (1, "a b c d e f")])
    assert jaccard.one_per_group(twice).count() == 1


def test_bitmap_bound_is_never_too_low():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = rng.integers(-1 << 62, 1 << 62, 400)
        a, b = np.unique(rng.choice(pool, rng.integers(1, 300))), np.unique(rng.choice(pool, rng.integers(1, 300)))
        top = jaccard.overlap_bound(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b))
        assert top >= len(np.intersect1d(a, b))


def test_one_per_group_keeps_clashing_columns(docs_of):
    from pyspark.sql import functions as F
    docs = docs_of([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n"), (3, "o p q r s t u"), (None, "x")])
    wide = docs.withColumns({c: F.lit("z") for c in ("__row", "_gone", "_twice", "other_doc", "rows", "print", "n")})
    got = jaccard.one_per_group(wide)
    assert got.columns == wide.columns and sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, None]


def passages(n):
    """Documents of 60 own words around a passage that all quote, and a near copy of every tenth."""
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(30))
    own = [[f"w{rng.randrange(1 << 40)}" for _ in range(60)] for _ in range(n)]
    docs = [(i, " ".join([*w[:30], common, *w[30:]])) for i, w in enumerate(own)]
    return docs + [(1000 + i, docs[i][1] + " changed") for i in range(0, n, 10)]


def test_crowded_passage_does_not_read_all_texts_again(docs_of, monkeypatch):
    read, old = [], jaccard._texts_of
    monkeypatch.setattr(jaccard, "_texts_of", lambda docs, ids: read.append(ids.count()) or old(docs, ids))
    docs = passages(120)
    assert result(jaccard.near_duplicates(docs_of(docs), crowd=20)) == brute(docs)
    assert read and max(read) <= 24     # the near copies and their originals, not every document with the passage


def test_many_crowded_shingles_cost_no_pass_over_them_per_document():
    import time
    rng = np.random.default_rng(3)
    hot = np.sort(rng.integers(-1 << 62, 1 << 62, 1 << 16))
    sets = [np.sort(rng.integers(-1 << 62, 1 << 62, 40)) for _ in range(20_000)]
    counts, flat = np.full(len(sets), 40), np.concatenate(sets)
    flat[::40] = hot[:len(sets)]
    began = time.process_time()
    h, doc, place = jaccard._prefixes(np.arange(len(sets)), counts, flat, counts, hot, 80, True)
    assert time.process_time() - began < 5      # np.isin per document: about a minute
    assert not np.isin(h, hot).any() and len(h) == 9 * len(sets)
    assert (place >> 32 == 40).all() and (place & 0xFFFFFFFF == np.tile(np.arange(9), len(sets))).all()


@pytest.mark.parametrize("labels, hot, block", [(0, 1 << 16, 4), (1 << 20, 1, 2)])
def test_bounds_change_nothing(docs_of, monkeypatch, labels, hot, block):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", labels)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIECE", 64)
    monkeypatch.setattr(jaccard._most, "__defaults__", (hot,))
    docs = corpus(3, 90) + [(2000 + i, t) for i, t in passages(30)]
    assert result(jaccard.near_duplicates(docs_of(docs), crowd=3)) == brute(docs)


def test_shingle_sets_of_short_and_empty_rows():
    import pyarrow as pa

    from rosterlake.llm.common import WordHash
    texts = ["", "a b", None, "a b c d e a b c d e f", "x", " ", "a b c d e", "B A"]
    flat, sizes = jaccard.shingle_sets(pa.array(texts), WordHash(lower=True))
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    cuts = np.cumsum(sizes)[:-1]
    rows = np.split(flat, cuts)
    assert all((np.diff(r) > 0).all() for r in rows)
    assert rows[6][0] in rows[3] and rows[1][0] != rows[7][0]
