"""Packing: ids against the tokenizer library, validity and size of the packing."""

import random
import zlib

import numpy as np
import pytest

from rosterlake.llm import packing
from rosterlake.llm.book import load
from rosterlake.llm.common import vocabulary

OP = load()[0]["op10_best_fit_packing"]


@pytest.fixture(scope="module")
def tokenize():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, texts, tokenize, capacity=2048):
    """Every document's pieces are its ids; every sequence is gapless from 0 and holds at most ``capacity``."""
    wanted = []
    for id_, text in texts:
        ids = np.array(tokenize(text), "<u4")
        n = len(ids)
        cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted.append((id_, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(wanted, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(w[3] for w in wanted)


def test_given_table(spark, sf_dir, tokenize):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, tokens = check(OP(spark, sf_dir).collect(), docs, tokenize)
    assert used <= 1.03 * -(-tokens // 2048)


def test_edge_rows(spark, stored, tokenize):
    docs = [(1, None), (2, ""), (None, "a b"), (3, "x" * 9000), (3, "x" * 9000), (4, "<|endoftext|> 's  \n\n é 中文 \U0001f600"),
            (5, "word " * 70_000), (6, " " * 5000), (7, "ab" * 4000), (8, "tab\t\ttab  nbsp em 123456 '''ll I'LL")]
    check(OP(spark, stored(docs)).collect(), docs, tokenize)


def test_special_tokens_and_random_texts(tokenize):
    from tokenizers import Tokenizer
    encode, plain = packing.encoder(vocabulary()), packing.encoder(vocabulary(), special=False)
    assert encode("hello <|endoftext|> world") == [31373, 220, 50256, 995]
    ordinary = Tokenizer.from_file(vocabulary())
    ordinary.encode_special_tokens = True
    rng = random.Random(9)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "it's", "é", "中", "123", "word", "\t", "<", "A", "\U0001f600", "'ll"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert encode(text) == tokenize(text)[:-1], text
        assert plain(text) == ordinary.encode(text, add_special_tokens=False).ids, text


def test_gaps_beyond_the_first_sixty_four():
    """Many bins with a gap of one token do not hide the bins that can take a piece."""
    capacity = 100
    lengths = [99] * 300 + [60] * 20 + [40] + [10] * 80
    bins = [[i] for i in range(300)] + [[300 + k] for k in range(20)] + [[320]] + [[321 + k] for k in range(80)]
    better = packing.improve(bins, lengths, capacity)
    assert sorted(i for b in better for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= capacity for b in better)
    assert len(better) == 321


def test_no_exchange_is_left():
    """What the search returns allows no move and no exchange that would fill bins more unevenly."""
    rng = random.Random(5)
    lengths = [rng.randint(20, 60) for _ in range(150)]
    bins = packing.improve([[i] for i in range(150)], lengths, 100)
    fill = [sum(lengths[i] for i in b) for b in bins]
    if len(bins) > -(-sum(lengths) // 100):
        for s, source in enumerate(bins):
            for t, target in enumerate(bins):
                if s == t:
                    continue
                for out in [[], *[[j] for j in target]]:
                    for into in [[i] for i in source] + [[i, j] for i in source for j in source if i < j and out]:
                        d = sum(lengths[i] for i in into) - sum(lengths[j] for j in out)
                        assert not (0 < d <= 100 - fill[t] and fill[t] - fill[s] + d > 0 and fill[t] < 100 and fill[s] < 100)


def test_empty_table_and_exact_multiples(spark, docs_of):
    assert packing.packed(docs_of([]), vocabulary()).collect() == []
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]


def test_shards(spark, docs_of, tokenize):
    docs = [(i, "some words " * (i % 90)) for i in range(300)]
    check(packing.packed(docs_of(docs), vocabulary(), shard_pieces=50).collect(), docs, tokenize)


@pytest.mark.parametrize("seed", range(4))
def test_local_search_empties_bins(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 2047) for _ in range(2000)]
    bins, fill = [[]], 0
    for i, n in enumerate(lengths):
        if fill + n > 2048:
            bins.append([])
            fill = 0
        bins[-1].append(i)
        fill += n
    better = packing.improve(bins, lengths)
    assert sorted(i for b in better for i in b) == list(range(2000))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in better)
    assert len(better) < 0.9 * len(bins)
    assert len(packing.improve(packing.best_fit(lengths), lengths)) <= len(packing.best_fit(lengths))


def test_exchanges_find_the_perfect_packing():
    # best-fit decreasing needs three bins of 10 here, an exchange makes it two
    lengths = [4, 4, 4, 3, 3, 2]
    bins = [[0, 1], [2, 3, 4], [5]]
    assert len(packing.improve(bins, lengths, 10)) == 2
