"""Benchmark decontamination against brute force and against its SQL."""

import hashlib
import random
import re

from check_oracles import compare

from rosterlake.llm import decontaminate
from rosterlake.llm.book import load

QUERIES, ORACLES = load()
NAME = "op5_benchmark_decontamination"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for id_, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in wins:
                    hit |= set(range(i, i + n))
                    ids |= {str(x) for x in wins[key] if x is not None}
        out.append((id_, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_oracle(spark, duck, sf_dir):
    verdict, _, ok = compare(spark, duck, sf_dir, NAME, QUERIES[NAME], ORACLES[NAME])
    assert ok, verdict


def test_random(spark, docs_of):
    rng = random.Random(3)
    vocab = ["a", "b", "É", "é", "c1", "ΑΣ", "İ"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(10, line(14)), (9, line(11)), (1, "A b"), (2, "c1"), (3, ""), (4, None), (11, line(14)), (9, "a b"), (None, "b b")]
    docs = [(i, line(rng.randint(0, 60)).replace(" ", rng.choice([" ", "-", ".\n"]))) for i in range(30)]
    docs += [(31, "x " + items[0][1].upper() + "."), (32, "..." + items[1][1] + " " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (10, 4):
        assert result(decontaminate.contamination(docs_of(docs), bench, size)) == brute(docs, items, size)


def test_edge_rows(spark, stored):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, " .,"), (None, item), (4, item), (4, item), (4, "other"), (5, "x " * 50_000 + item.upper()),
            (6, "one two three four five six seven eight nine. ten"), (7, "one two three four five six seven eight nine")]
    bench = spark.createDataFrame([(7, item), (7, item), (8, "zzz yyy")], "item_id long, text string")
    path = stored(docs, benchmark=bench)
    assert result(QUERIES[NAME](spark, path)) == brute(docs, [(7, item), (8, "zzz yyy")])


def test_empty_tables_and_extra_columns(spark, docs_of):
    from pyspark.sql import functions as F
    bench = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    docs = docs_of([(1, "a b c d"), (2, "a"), (None, "a b c"), (None, "c")])
    for name in ("doc", "w", "n_words", "term", "pos", "words"):
        docs = docs.withColumn(name, F.lit("x"))
    assert [r[-1] for r in result(decontaminate.contamination(docs, bench))] == [True, False, False, True]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["a", "c"]
    assert result(decontaminate.contamination(docs_of([]), bench)) == []
    assert not any(r[-1] for r in result(decontaminate.contamination(docs, bench.limit(0))))


def test_proximity(spark, docs_of):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = docs_of([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "delta gamma beta alpha"),
                    (4, "alpha beta gamma"), (5, "alpha x x x x beta gamma delta"), (6, "beta alpha gamma delta")])
    places, _ = decontaminate.test_windows(bench)
    postings = decontaminate.index(docs, places)
    keys = {r.doc: r.doc_id for r in decontaminate.sizes(docs).collect()}
    near = lambda slop: sorted({keys[r.doc] for r in decontaminate.proximity_matches(postings, places, slop).collect()})
    assert near(0) == [1] and near(1) == [1, 2, 6] and near(3) == [1, 2, 6]
    assert near(4) == [1, 2, 5, 6] and near(6) == [1, 2, 3, 5, 6]


def test_clean_keeps_clashing_columns(docs_of):
    from pyspark.sql import functions as F
    item = " ".join(f"w{k}" for k in range(12)).translate(str.maketrans("0123456789", "abcdefghij"))
    docs = docs_of([(1, item), (2, "quite another text"), (None, None)])
    wide = docs.withColumns({c: F.lit("z") for c in ("__bad", "contaminated_doc", "doc", "w", "pos", "id")})
    items = docs.sparkSession.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.clean(wide, items)
    assert got.columns == wide.columns and sorted((r.doc_id for r in got.collect()), key=str) == [2, None]


def test_passages_with_a_word_put_in_or_left_out(spark, docs_of):
    words_ = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    item = " ".join(words_)
    docs = docs_of([(1, item), (2, " ".join(w + (" extra" if k % 7 == 3 else "") for k, w in enumerate(words_))), (3, " ".join(words_[:6] + words_[7:14])),
                    (4, " ".join(reversed(words_))), (5, "quite another text"), (6, " ".join(words_[:4] + ["x"] * 9 + words_[4:9]))])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert got[1].n_near == 31 and got[1].contaminated
    assert got[2].n_hit == 0 and got[2].n_near > 0
    assert got[4].n_near == got[5].n_near == got[6].n_near == 0
