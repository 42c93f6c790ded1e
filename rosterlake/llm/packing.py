"""Best-fit packing with swap-based local search.

Documents become token pieces of at most ``CAPACITY`` tokens.  Full pieces are sequences of their own.  The others
are dealt by a hash of their identity over shards of a bounded number of pieces; a shard is packed best-fit
decreasing, then improved by moves, one-for-one and two-for-one exchanges from the emptiest bins into the gaps of
fuller ones.  Every exchange increases the sum of squared fills; a bin that loses its last piece is gone.  Only
(identity, length) rows reach a shard, never texts or ids.

Shards keep memory bounded at any input size.  What they cost is one underfull bin or so each, one sequence in
some tens of thousands.
"""

import bisect
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import in_arrow, slices

CAPACITY = 2048
END = 0               # id that ends a document
SHARD_PIECES = 40_000  # pieces that one task packs at most, on average


def encoder(path, special=True):
    """Text -> ids, as the tokenizer library gives them for the vocabulary file without adding special tokens.

    The byte-level vocabulary gives the ranks.  Strings of special tokens become those tokens' ids; with
    ``special=False`` they are ordinary text.
    """
    import json
    import re

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if any(x.get(flag) for x in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path}: added tokens that take blanks with them are not supported")
    # byte-level vocabularies write bytes as printable characters: printable ones as they are, the rest from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain}
    chars.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    ranks = {bytes(chars[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
    encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                               special_tokens={}).encode_ordinary
    if not special or not added:
        return encode
    marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode_all(text):
        if not marks.search(text):
            return encode(text)
        out = []
        for k, part in enumerate(marks.split(text)):
            out.extend([added[part]] if k % 2 else encode(part))
        return out
    return encode_all


def cut(n: int, capacity=CAPACITY):
    """(start, length) of the pieces of ``n`` tokens: all full but the first."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces_of(ids, capacity=CAPACITY):
    """(piece, start, length, crc32) of one document's ids, its end mark included."""
    raw = np.asarray(ids, dtype="<u4")
    return [(k, s, n, zlib.crc32(raw[s:s + n].tobytes())) for k, (s, n) in enumerate(cut(len(raw), capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path, capacity):
    def run(batches):
        encode = None
        for batch in slices(batches):
            encode = encode or encoder(path)
            out = [[] for _ in range(5)]
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in pieces_of(encode(text or "") + [END], capacity):
                    for column, value in zip(out, (id_, *row)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, path: str, capacity=CAPACITY) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).transform(in_arrow,
        _pieces(path, capacity), PIECES)


def best_fit(lengths, capacity=CAPACITY):
    """Best-fit decreasing: list of bins, each a list of positions in ``lengths``."""
    bins, gaps = [], [[] for _ in range(capacity + 1)]   # gaps[g]: bins with g tokens free
    open_gaps = []                                       # sorted sizes of the gaps in use
    for at in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        n = lengths[at]
        k = bisect.bisect_left(open_gaps, n)
        if k < len(open_gaps):
            gap = open_gaps[k]
            bin_ = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(k)
        else:
            gap, bin_ = capacity, len(bins)
            bins.append([])
        bins[bin_].append(at)
        rest = gap - n
        if rest:
            if not gaps[rest]:
                bisect.insort(open_gaps, rest)
            gaps[rest].append(bin_)
    return bins


class Bins:
    """Underfull bins by their gap, and their pieces by gap and length."""

    def __init__(self, bins, lengths, capacity):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.by_gap = [{} for _ in range(capacity + 1)]   # gap -> bins in order of entry
        self.gap_list = []                                # sorted gaps in use
        self.holders = [{} for _ in range(capacity + 1)]  # gap -> piece length -> bins with such a piece
        self.held = [[] for _ in range(capacity + 1)]     # gap -> sorted piece lengths
        for b in range(len(bins)):
            self._enter(b)

    def _enter(self, b):
        gap = self.capacity - self.fill[b]
        if 0 < gap < self.capacity:
            if not self.by_gap[gap]:
                bisect.insort(self.gap_list, gap)
            self.by_gap[gap][b] = True
            for n in {self.lengths[i] for i in self.bins[b]}:
                if n not in self.holders[gap]:
                    bisect.insort(self.held[gap], n)
                    self.holders[gap][n] = {}
                self.holders[gap][n][b] = True

    def _leave(self, b):
        gap = self.capacity - self.fill[b]
        if b not in self.by_gap[gap]:
            return
        del self.by_gap[gap][b]
        if not self.by_gap[gap]:
            self.gap_list.pop(bisect.bisect_left(self.gap_list, gap))
        for n in {self.lengths[i] for i in self.bins[b]}:
            del self.holders[gap][n][b]
            if not self.holders[gap][n]:
                del self.holders[gap][n]
                self.held[gap].pop(bisect.bisect_left(self.held[gap], n))

    def replace(self, b, out, into):
        """Takes pieces ``out`` from bin ``b`` and puts ``into`` there."""
        self._leave(b)
        for i in out:
            self.bins[b].remove(i)
            self.fill[b] -= self.lengths[i]
        for i in into:
            self.bins[b].append(i)
            self.fill[b] += self.lengths[i]
        self._enter(b)

    def gains(self, source, target, moved):
        """Whether ``moved`` tokens from source to target increase the sum of squared fills."""
        return self.fill[target] - self.fill[source] + moved > 0

    def exchange(self, source, target, out, into):
        self.replace(source, into, out)
        self.replace(target, out, into)

    def other(self, bins, source):
        """The first of some bins that is not ``source``."""
        return next((b for b in itertools.islice(bins, 2) if b != source), None)

    def room(self, source, n):
        """A bin with the tightest gap that takes ``n`` more tokens."""
        for gap in self.gap_list[bisect.bisect_left(self.gap_list, n):]:
            b = self.other(self.by_gap[gap], source)
            if b is not None:
                return b if self.gains(source, b, n) else None   # wider gaps are emptier bins
        return None

    def partner(self, source, total):
        """(bin, piece) to give back for ``total`` tokens: of the tightest gaps first, the piece that fills most."""
        for gap in self.gap_list:
            lengths = self.held[gap]
            k = bisect.bisect_left(lengths, max(total - gap, 1))
            while k < len(lengths) and lengths[k] < total:
                b = self.other(self.holders[gap][lengths[k]], source)
                if b is not None:
                    if self.gains(source, b, total - lengths[k]):
                        return b, next(j for j in self.bins[b] if self.lengths[j] == lengths[k])
                    break                                         # longer pieces give back more, and gain less
                k += 1
        return None


def improve(bins, lengths, capacity=CAPACITY):
    """Moves pieces out of the emptiest bins until no exchange is left; returns the bins that still hold something.

    For the pieces of a bin, the emptiest bins first: move one into the tightest gap that takes it; else exchange it
    for one smaller piece of a bin whose gap takes the difference; else two of its pieces for one.  Each step
    increases the sum of squared fills, so the search ends.  Gaps and pieces are looked up by size, so every bin is
    a possible target and every pair of pieces is tried.  It also ends at the bound total / capacity.
    """
    state = Bins([list(b) for b in bins], lengths, capacity)
    least = -(-sum(lengths) // capacity)

    def step(source):
        held = {}
        for i in sorted(state.bins[source], key=lambda i: (-lengths[i], i)):
            held.setdefault(lengths[i], []).append(i)
        for n, own in held.items():
            if (b := state.room(source, n)) is not None:
                return b, (), (own[0],)
        for n, own in held.items():
            if found := state.partner(source, n):
                return found[0], (found[1],), (own[0],)
        tried = set()
        for n, own in held.items():
            for m, more in held.items():
                if m <= n and (m < n or len(own) > 1) and n + m not in tried:
                    tried.add(n + m)
                    if found := state.partner(source, n + m):
                        return found[0], (found[1],), (own[0], more[0] if m < n else own[1])
        return None

    left = sum(map(bool, state.bins))
    moved = True
    while moved and left > least:
        moved = False
        for source in sorted((b for gap in state.gap_list for b in state.by_gap[gap]), key=lambda b: (state.fill[b], b)):
            while state.bins[source] and (found := step(source)):
                state.exchange(source, *found)
                moved = True
            if not state.bins[source]:
                left -= 1
                if left <= least:
                    break
    return [b for b in state.bins if b]


def pack(lengths, capacity=CAPACITY):
    """(bin, offset) per piece."""
    out = [None] * len(lengths)
    for b, members in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
        at = 0
        for i in members:
            out[i] = (b, at)
            at += lengths[i]
    return out


def _pack_shards(capacity):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        rows = rows.sort_by([("shard", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        shards = rows.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(edges, edges[1:]):
            part = rows.slice(a, b - a)
            placed = pack(part.column("length").to_pylist(), capacity)
            base = int(shards[a]) << 32
            out = part.append_column("sequence_id", pa.array([base + p[0] for p in placed], pa.int64()))
            out = out.append_column("offset", pa.array([p[1] for p in placed], pa.int64())).drop_columns(["shard", "copy"])
            yield from out.combine_chunks().to_batches()
    return run


def packed(docs: DataFrame, path: str, capacity=CAPACITY, shard_pieces=SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece with its place.

    Null text counts as empty and is one piece (the end mark).  Repeated rows and rows with a null doc_id are
    documents of their own.  An empty table gives no sequences; other columns are ignored.
    """
    all_ = materialise(pieces(docs, path, capacity), "pieces")
    shards = max(1, -(-all_.filter(F.col("length") < capacity).count() // shard_pieces))
    # the content check sum takes part, so that copies of one id do not meet in one shard
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(shards)).cast("long")
    # one shard a partition: whole shards are dealt by their number, which takes almost no time to pack
    short = (all_.filter(F.col("length") < capacity).withColumn("copy", F.monotonically_increasing_id())
             .withColumn("shard", shard))
    placed = short.repartition(shards, "shard").transform(in_arrow,
        _pack_shards(capacity), PIECES + ", sequence_id long, offset long")
    full = all_.filter(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
