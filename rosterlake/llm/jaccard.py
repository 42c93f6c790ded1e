"""N-gram Jaccard join: tiles by (rare shingle, size band), bitmap bounds, exact sorted-array intersection.

Rows with equal shingle sets form one class.  A class is represented by its smallest id; only representatives
are compared, so copies are never expanded into pairs.

1. ``signatures`` turns a text into the sorted hashes of its distinct word shingles; kept per document are the
   size, a 128-bit fingerprint, the first hashes (the *prefix*; two linked sets always share a hash of it) and as
   many again, and a bitmap of four to eight bits per shingle.
2. Hashes that more than ``crowd`` documents share come last in the order that prefixes are taken from, so a passage
   that many documents quote does not put them all into one tile.  Any order gives the same links; so the list of
   such hashes may be bounded (``HOT``), and it is sent to all executors.  Only where most of the first hashes are
   crowded is the text read again for the rest of the prefix.
3. Hashes travel as bytes, one row per task and *piece* of the hash space.  Prefix hashes seen in one class only are
   dropped: a tile needs two members.  A row of ``tiles`` holds all tiles of a piece, so later steps need no shuffle.
4. In every tile (hash, size band) members are first compared with one leader, which costs one candidate per
   member.  The links found merge whole groups of near copies before any pair inside them could be listed.
5. What is left are tiles with members of different components.  Their cross-component pairs are listed, unless
   the sizes or the places of the hash in both prefixes already exclude a link.  Members of crowded tiles are dealt
   out in blocks, and bitmaps of one size (``SKETCH``) are compared before a pair is listed at all.
6. Before sets are fetched, the number of differing bits bounds the overlap from above.  The survivors' sets are
   computed again from the texts, and intersected exactly.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import SPACE, WordHash, bytes_array, bytes_of, free_name, in_arrow, list_array, mix, offsets_of, slices, spans, windows, within
from .components import components

WORDS = 5          # words of a shingle
PERCENT = 80       # Jaccard similarity of a link, in percent
CROWD = 100        # documents beyond which a shared shingle moves to the end of the prefix order
HOT = 1 << 16      # such shingles at most (0.5 MB); the most frequent ones if there are more
BROADCAST_IDS = 1 << 20   # ids, or ids and their components, sent to all executors at most (8, 16 MB); more are joined by a shuffle
ROUNDS = 2         # leader rounds before the full comparison
PIECE = 1 << 18    # hashes in a piece of the hash space
TILES = ["h", "doc", "place", "component"]   # place: set size and place in the prefix, 32 bits each
BLOCK = 1 << 12    # members of a large tile that are compared in one place
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
DEALT = 1 << 21    # hashes that a task holds before it deals them out
SKETCH = 1024      # bits of the bitmaps that are compared inside crowded tiles


def need(n, percent=PERCENT):
    """Shingles that a set of ``n`` has at least in common with any set it links with."""
    return -(-percent * n // 100)


def short(n, percent=PERCENT):
    """Length of the prefix of a set of ``n``."""
    return n - need(n, percent) + (n > 0)


def shingle_sets(col: pa.Array, hasher: WordHash, words=WORDS):
    """Sorted distinct shingle hashes of every row: (flat int64 array, sizes).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  Fewer words than a shingle has: the
    whole sequence is the only shingle.  No words or null: empty set.
    """
    data, offsets = bytes_of(col)
    starts, ends, counts = spans(data, offsets, SPACE)
    hashes = hasher(data, starts, ends)
    at, each = within(counts, words)
    rolled = windows(hashes, words)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
    edge = np.concatenate(([0], np.cumsum(each)))
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
        rolled[low:high].sort()
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = rolled[1:] != rolled[:-1]
    fresh[edge[:-1][each > 0]] = True
    flat, before = rolled[fresh], np.concatenate(([0], np.cumsum(fresh)))[edge]
    sizes = np.diff(before)
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        first = np.concatenate(([0], np.cumsum(counts)))
        only = [windows(hashes[first[i]:first[i + 1]], int(counts[i])).view(np.int64)[0] for i in few]
        flat = np.insert(flat, before[few], only)
        sizes[few] = 1
    return flat, sizes


def _width(n: int) -> int:
    """The power of two at or above four times the set's size, 64 bits at least."""
    return max(64, 1 << (4 * n - 1).bit_length()) if n else 64


def bitmap(values: np.ndarray) -> bytes:
    """One bit per hash, in ``_width`` bits."""
    return _bit_rows(values, np.array([len(values)]), np.array([_width(len(values))]))[0].as_py()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A wider bitmap reduced to ``size`` bytes: its parts laid over each other."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """At most this many hashes are common: every differing bit is a hash of one set only."""
    size = min(len(a), len(b))
    x, y = folded(np.frombuffer(a, np.uint8), size), folded(np.frombuffer(b, np.uint8), size)
    differ = int(np.bitwise_count(x ^ y).sum())
    return (n_a + n_b - differ) // 2


def _bit_rows(flat, sizes, widths) -> pa.Array:
    """Bitmaps of all rows, of the given widths; null for an empty set."""
    edge = np.concatenate(([0], np.cumsum(np.where(sizes > 0, widths, 0))))
    bits = np.zeros(edge[-1], bool)
    bits[np.repeat(edge[:-1], sizes) + (flat & np.repeat(widths - 1, sizes))] = True
    return bytes_array(np.packbits(bits, bitorder="little"), edge // 8, sizes > 0)


def _signatures(percent):
    def run(batches):
        hasher = WordHash(lower=True)
        for batch in slices(batches):
            flat, sizes = shingle_sets(batch.column(1), hasher)
            edge = np.concatenate(([0], np.cumsum(sizes)))
            raw = memoryview(flat.tobytes())
            prints = [hashlib.blake2b(raw[8 * low:8 * high], digest_size=16).digest() if high > low else None
                      for low, high in zip(edge[:-1].tolist(), edge[1:].tolist())]
            widths = np.array([_width(n) for n in sizes.tolist()], np.int64)
            firsts = np.minimum(sizes, 2 * short(sizes, percent))
            rank = np.arange(len(flat)) - np.repeat(edge[:-1], sizes)
            sketches = np.zeros(SKETCH * len(sizes), bool)
            sketches[np.repeat(SKETCH * np.arange(len(sizes)), sizes) + (flat & (SKETCH - 1))] = True
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes), pa.array(prints, pa.binary()),
                bytes_array(flat[rank < np.repeat(firsts, sizes)], 8 * np.concatenate(([0], np.cumsum(firsts)))),
                _bit_rows(flat, sizes, widths),
                bytes_array(np.packbits(sketches, bitorder="little"), SKETCH // 8 * np.arange(len(sizes) + 1))],
                names=["doc_id", "n", "print", "head", "bits", "sketch"])
    return run


def signatures(docs: DataFrame, percent=PERCENT) -> DataFrame:
    """doc_id, n (set size), print (fingerprint), head (prefix and as many hashes again, 8 bytes each), bits, sketch (``SKETCH`` bits).

    One row per row of ``docs``.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(in_arrow,
        _signatures(percent), "doc_id long, n long, print binary, head binary, bits binary, sketch binary")


def _sets(batches):
    hasher = WordHash(lower=True)
    for batch in slices(batches):
        flat, sizes = shingle_sets(batch.column(1), hasher)
        yield pa.RecordBatch.from_arrays([batch.column(0), list_array(flat, sizes)], names=["doc_id", "items"])


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the given documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(_checked(ids), "doc_id", "left_semi")


def _bounded(percent):
    """Keeps candidate pairs whose bitmaps leave the link possible."""
    def run(batches):
        for batch in batches:
            a, b, n_a, n_b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(batch.num_rows):
                top = overlap_bound(x[i], y[i], n_a[i], n_b[i])
                keep.append(100 * top >= percent * (n_a[i] + n_b[i] - top))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _verified(percent):
    """Keeps pairs whose sorted arrays really overlap enough."""
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _links(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, percent) -> DataFrame:
    """Exact links among candidate pairs (a, b), written to the shared folder."""
    one = sizes.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = sizes.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    possible = (pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
                .transform(in_arrow, _bounded(percent), "a long, b long"))
    possible = materialise(possible, "pairs")
    ids = possible.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialise(_texts_of(docs, ids).transform(in_arrow, _sets, "doc_id long, items array<long>"), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    found = (possible.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")
             .transform(in_arrow, _verified(percent), "a long, b long").distinct())
    return materialise(found, "links")


def _band(n: np.ndarray) -> np.ndarray:
    """Size band; linked sets lie in the same or in neighbouring bands."""
    return np.floor(np.log(n) / np.log(100 / PERCENT)).astype(np.int64)


def _among(values, ordered):
    """Which values are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def _dealt(columns, pieces) -> pa.RecordBatch:
    """One row per piece of the hash space: its number, and the longs of each column as bytes; the hashes come first."""
    piece = (columns[0] & (pieces - 1)).astype(np.min_scalar_type(pieces - 1))
    order = np.argsort(piece, kind="stable")
    edge = np.concatenate(([0], np.cumsum(np.bincount(piece, minlength=pieces))))
    some = np.flatnonzero(np.diff(edge))
    cuts = np.append(edge[some], edge[-1])
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), *(bytes_array(c[order], 8 * (c.size // len(c)) * cuts) for c in columns)],
        names=["piece", *(f"c{i}" for i in range(len(columns)))])


def _longs(col: pa.Array) -> np.ndarray:
    return bytes_of(col)[0].view(np.int64)


def _in_pieces(sources, gather, columns, schema) -> DataFrame:
    """Of each (table, function) in ``sources`` the function makes rows of ``_dealt``; ``gather`` gets the longs of a whole piece."""
    kinds = "piece int, " + ", ".join(f"c{i} binary" for i in range(columns))
    dealt = reduce(DataFrame.unionByName, [in_arrow(df, deal, kinds) for df, deal in sources])

    def run(batches):
        now, held = None, []

        def whole():
            return gather(*(np.concatenate(c) for c in zip(*held)))
        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else [0]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if held and number[low] != now:
                    yield whole()
                    held = []
                now = number[low]
                held.append([_longs(c.slice(low, high - low)) for c in batch.columns[1:]])
        if held:
            yield whole()
    return dealt.repartition("piece").sortWithinPartitions("piece").transform(in_arrow, run, schema)


def _runs(values):
    """Starts and lengths of runs of equal values."""
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    return edge, np.diff(np.append(edge, len(values)))


def _runs_of(one, two):
    """Starts and lengths of runs of equal pairs."""
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(one)), bool), (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
    return edge, np.diff(np.append(edge, len(one)))


def _gathered(parts, make, most=DEALT):
    """Batches that ``make`` forms of the concatenated arrays of ``parts``, some ``most`` values at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield make(*(np.concatenate(c) for c in zip(*held)))
            held, size = [], 0
    if size:
        yield make(*(np.concatenate(c) for c in zip(*held)))


def _list_values(col: pa.Array):
    """(longs of all rows, longs per row) of a binary column without nulls."""
    return _longs(col), np.diff(offsets_of(col)) // 8


def _counting(pieces):
    """The hashes of all heads, and how many documents of the task have each."""
    def make(values):
        values = np.sort(values)
        edge, members = _runs(values)
        return _dealt([values[edge], members], pieces)

    def run(batches):
        yield from _gathered(([_list_values(b.column(0))[0]] for b in batches), make)
    return run


def _crowded(crowd):
    """Hashes that more than ``crowd`` documents have."""
    def run(hashes, members):
        order = np.argsort(hashes)
        edge, _ = _runs(hashes[order])
        total = np.add.reduceat(members[order], edge)
        most = total > crowd
        return pa.RecordBatch.from_arrays([pa.array(hashes[order][edge[most]]), pa.array(total[most])], names=["h", "members"])
    return run


def _placed(flat, counts, late):
    """Places of hashes in the order that puts ``late`` ones last, and per row how many are not late."""
    edge = np.concatenate(([0], np.cumsum(counts)))
    early = np.concatenate(([0], np.cumsum(~late)))
    first, total = np.repeat(early[edge[:-1]], counts), early[edge[1:]] - early[edge[:-1]]
    rank = early[:-1] - first
    place = np.where(late, np.repeat(total, counts) + np.arange(len(flat)) - np.repeat(edge[:-1], counts) - rank, rank)
    return place, total


def _prefixes(doc, n, flat, counts, hot, percent, whole):
    """(h, doc, n and place) of the prefixes in the order that puts the hashes ``hot`` last.

    ``whole``: the values are whole sets; else rows whose first values do not hold their prefix are left out.
    """
    prefix = short(n, percent)
    place, early = _placed(flat, counts, _among(flat, hot))
    kept = place < np.repeat(prefix if whole else np.where(early >= prefix, prefix, 0), counts)
    row = np.repeat(np.arange(len(n)), counts)[kept]
    return flat[kept], doc[row], (n[row] << 32) | place[kept]


def _short_of(hot, percent):
    """Documents whose head does not hold their prefix, when the hashes ``hot`` come last."""
    def run(batches):
        for batch in batches:
            flat, counts = _list_values(batch.column(2))
            early = np.concatenate(([0], np.cumsum(~_among(flat, hot))))[np.concatenate(([0], np.cumsum(counts)))]
            yield batch.select([0]).filter(pa.array(np.diff(early) < short(batch.column(1).to_numpy(), percent)))
    return run


def _from_heads(hot, percent, pieces):
    """Prefixes out of (doc, n, head)."""
    def run(batches):
        yield from _gathered((_prefixes(b.column(0).to_numpy(), b.column(1).to_numpy(), *_list_values(b.column(2)), hot, percent, False)
                              for b in batches), lambda *c: _dealt(c, pieces))
    return run


def _from_texts(hot, percent, pieces):
    """Prefixes out of (doc_id, text)."""
    def parts(batches):
        hasher = WordHash(lower=True)
        for batch in slices(batches):
            flat, sizes = shingle_sets(batch.column(1), hasher)
            yield _prefixes(batch.column(0).to_numpy(), sizes, flat, sizes, hot, percent, True)

    def run(batches):
        yield from _gathered(parts(batches), lambda *c: _dealt(c, pieces))
    return run


def _tiles(hashes, docs, places, *labels):
    """The rows of a piece whose hash has two members at least, ordered; repeated rows count once.  One row of bytes."""
    order = np.argsort(hashes)
    _, size = _runs(hashes[order])
    order = order[np.repeat(size > 1, size)]
    order = order[np.lexsort((places[order], docs[order], hashes[order]))]
    columns = [c[order] for c in (hashes, docs, places, *labels)]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array([c[fresh].tobytes()], pa.binary()) for c in columns], names=TILES[:len(columns)])


def _most(counts: DataFrame, most=HOT) -> DataFrame:
    return counts.orderBy(F.desc("members"), "h").limit(most).select("h")


def _checked(ids: DataFrame, most=BROADCAST_IDS) -> DataFrame:
    """``ids`` for all executors if they are few enough; else they are joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _kinds(columns):
    return ", ".join(f"{name} binary" for name in TILES[:columns])


def _postings(docs: DataFrame, kept: DataFrame, percent, crowd):
    """(tiles, pieces): prefix hashes that have two members, their documents, set sizes and places in the prefixes.

    Hashes travel as bytes, one row per task and piece of the hash space; a row of ``tiles`` holds all of one piece.
    """
    total = kept.agg(F.sum("n")).first()[0] or 0
    pieces = 1 << (total * (100 - percent) // 100 // PIECE).bit_length()
    counts = _in_pieces([(kept.select("head"), _counting(pieces))], _crowded(crowd), 2, "h long, members long")
    hot = np.sort(np.array([r["h"] for r in _most(counts).collect()], np.int64))     # HOT numbers at most
    dealt = [(kept, _from_heads(hot, percent, pieces))]
    if len(hot):
        # where most of a head is crowded, the rest of the prefix is in the text only
        rest = materialise(kept.transform(in_arrow, _short_of(hot, percent), "doc long").select(F.col("doc").alias("doc_id")).distinct(), "rest")
        if not rest.isEmpty():
            dealt.append((_texts_of(docs, rest), _from_texts(hot, percent, pieces)))
    return materialise(_in_pieces(dealt, _tiles, 3, _kinds(3)), "tiles"), pieces


def _labelled(tiles: DataFrame, merged: DataFrame, pieces) -> tuple:
    """(tiles, labels): the components of ``merged`` for all tasks if they are few enough, else as a column of the tiles."""
    if merged.count() <= BROADCAST_IDS:
        found = merged.toArrow()
        nodes, labels = (found.column(c).to_numpy() for c in ("node", "component"))
        order = np.argsort(nodes)
        return tiles, (nodes[order], labels[order])

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_longs(c)) for c in batch.columns], names=TILES[:3])

    def deal(batches):
        yield from _gathered(([c.to_numpy() for c in b.columns] for b in batches), lambda *c: _dealt(c, pieces))
    long_ = tiles.select(*TILES[:3]).transform(in_arrow, rows, ", ".join(f"{name} long" for name in TILES[:3]))
    joined = (long_.join(merged.withColumnRenamed("node", "doc"), "doc", "left")
              .select(*TILES[:3], F.coalesce("component", "doc").alias("component")))
    return materialise(_in_pieces([(joined, deal)], _tiles, 4, _kinds(4)), "tiles"), None


def _each_tile(batches, labels):
    """(number of the tile, doc, n, pos, component) of the rows of each piece; hashes whose members are one component are left out."""
    for batch in batches:
        for i in range(batch.num_rows):
            h, doc, place, *component = (_longs(c.slice(i, 1)) for c in batch.columns)
            component = component[0] if component else doc
            if labels and len(labels[0]):
                known = _among(doc, labels[0])
                component = doc.copy()
                component[known] = labels[1][np.searchsorted(labels[0], doc[known])]
            edge, size = _runs(h)
            if len(edge):
                mixed = np.repeat(np.minimum.reduceat(component, edge) < np.maximum.reduceat(component, edge), size)
                tile = np.repeat(np.arange(len(edge)), size)
                yield h[mixed], tile[mixed], doc[mixed], place[mixed] >> 32, place[mixed] & ((1 << 32) - 1), component[mixed]


def _pairs(a, b):
    """Distinct pairs, the smaller id first."""
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], names=["a", "b"])


def _led(round_, labels, percent):
    """Pairs of a leader of each tile and size band with the members of other components."""
    def run(batches):
        for h, tile, doc, n, pos, component in _each_tile(batches, labels):
            if not len(h):
                continue
            band = _band(n)
            # at first the same leader wherever it is a member; later another one in every tile
            by = mix(doc.view(np.uint64) ^ mix(h.view(np.uint64) + np.uint64(round_))) if round_ else doc
            order = np.lexsort((by, band, tile))
            edge, size = _runs((tile[order] << 16) + band[order])
            y = np.repeat(order[edge], size)
            keep = (component[order] != component[y]) & _fit(n[order], pos[order], n[y], pos[y], percent)
            yield _pairs(doc[order[keep]], doc[y[keep]])
    return run


def _near_sizes(tile, n, percent, at=None):
    """(x, y) of the rows ``at`` and all rows of their tile whose size allows a link, some at a time; rows are ordered by tile and size.

    Without ``at`` each two rows meet once.
    """
    key = (tile << 32) + n
    if at is None:
        at = np.arange(len(n))
        low = at + 1
    else:
        low = np.searchsorted(key, (tile[at] << 32) + need(n[at], percent))
    each = np.searchsorted(key, (tile[at] << 32) + 100 * n[at] // percent, side="right") - low
    total = np.concatenate(([0], np.cumsum(each)))
    first = 0
    while first < len(at):
        stop = max(first + 1, int(np.searchsorted(total, total[first] + PIECE, side="right")) - 1)
        count = each[first:stop]
        yield np.repeat(at[first:stop], count), np.arange(total[stop] - total[first]) + np.repeat(low[first:stop] - total[first:stop] + total[first], count)
        first = stop


def _met(labels, percent, crowd):
    """Pairs of members of different components in tiles of up to ``crowd`` members."""
    def run(batches):
        for h, tile, doc, n, pos, component in _each_tile(batches, labels):
            _, size = _runs(tile)
            small = np.flatnonzero(np.repeat(size <= crowd, size))
            order = small[np.lexsort((n[small], tile[small]))]
            tile, doc, n, pos, component = (c[order] for c in (tile, doc, n, pos, component))
            for x, y in _near_sizes(tile, n, percent):
                keep = (component[x] != component[y]) & _fit(n[x], pos[x], n[y], pos[y], percent)
                yield _pairs(doc[x[keep]], doc[y[keep]])
    return run


def _crowds(labels, percent, crowd):
    """Members of larger tiles: each as ``y`` in a block of its tile, and in all blocks that hold sizes near its own as ``x``.

    Members of the tile's largest component (role 0) are not compared with each other, so they are no ``x`` (role 1).
    """
    def run(batches):
        for h, tile, doc, n, pos, component in _each_tile(batches, labels):
            _, size = _runs(tile)
            large = np.flatnonzero(np.repeat(size > crowd, size))
            order = large[np.lexsort((n[large], component[large], tile[large]))]
            edge, members = _runs_of(tile[order], component[order])
            group = np.repeat(np.arange(len(edge)), members)
            most = np.lexsort((edge, members, tile[order][edge]))
            main = np.zeros(len(edge), bool)
            main[most] = np.append(np.diff(tile[order][edge][most]) != 0, np.ones(min(1, len(edge)), bool))
            sized = np.lexsort((n[order], tile[order]))
            order, main = order[sized], main[group][sized]
            tile, n = tile[order], n[order]
            edge, size = _runs(tile)
            start = np.repeat(edge, size)
            x = np.flatnonzero(~main)
            key = (tile << 32) + n
            low = (np.searchsorted(key, (tile[x] << 32) + need(n[x], percent)) - start[x]) // BLOCK
            high = (np.searchsorted(key, (tile[x] << 32) + 100 * n[x] // percent, side="right") - 1 - start[x]) // BLOCK
            each = high - low + 1
            block = np.concatenate(((np.arange(len(n)) - start) // BLOCK,
                                    np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())))
            row = np.concatenate((np.arange(len(n)), np.repeat(x, each)))
            role = np.concatenate((np.where(main, 0, 2), np.ones(each.sum(), np.int64)))
            hashes = mix(h[order][row].view(np.uint64) + mix(block.astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (hashes, doc[order][row], n[row], (n[row] << 32) | pos[order][row], component[order][row], role)],
                names=["h", "doc", "n", "place", "component", "role"])
    return run


def _crowded_pairs(marked: DataFrame, sketches: DataFrame, percent) -> DataFrame:
    """Pairs (a, b) of members of different components in large tiles, where sizes, places and sketches leave a link possible."""
    pieces = 1 << (marked.count() // BLOCK).bit_length()
    rows = marked.join(sketches, ["doc", "n"]).select("h", "doc", "place", "component", "role", "sketch")

    def parts(batches):
        for batch in batches:
            yield [*(c.to_numpy() for c in batch.columns[:5]), _longs(batch.column(5)).reshape(batch.num_rows, -1)]

    def deal(batches):
        yield from _gathered(parts(batches), lambda *c: _dealt(c, pieces), DEALT // 16)

    def compare(h, doc, place, component, role, bits):
        bits = bits.reshape(len(h), -1)
        order = np.lexsort((place >> 32, h))
        doc, place, component, role, bits = (c[order] for c in (doc, place, component, role, bits))
        _, size = _runs(h[order])
        tile, n, pos = np.repeat(np.arange(len(size)), size), place >> 32, place & ((1 << 32) - 1)
        found = []
        for x, y in _near_sizes(tile, n, percent, np.flatnonzero(role == 1)):
            keep = (role[y] != 1) & (component[x] != component[y]) & ((role[y] == 0) | (doc[x] < doc[y]))
            x, y = x[keep], y[keep]
            keep = _fit(n[x], pos[x], n[y], pos[y], percent)
            x, y = x[keep], y[keep]
            room = (100 - percent) * (n[x] + n[y])       # (100 + percent) times the hashes that one of both sets may have alone
            for part in (slice(0, 4), slice(4, None)):
                room = room - (100 + percent) * np.bitwise_count(bits[x, part] ^ bits[y, part]).sum(axis=1, dtype=np.int64)
                x, y, room = x[room >= 0], y[room >= 0], room[room >= 0]
            found.append(_pairs(doc[x], doc[y]))
        return pa.Table.from_batches(found, PAIR).combine_chunks().to_batches()[0] if sum(f.num_rows for f in found) else _pairs(doc[:0], doc[:0])
    return _in_pieces([(rows, deal)], compare, 6, "a long, b long")


def _fit(n_x, pos_x, n_y, pos_y, percent):
    """What sizes and places of a shared hash leave possible: no more than the rest of either prefix order is common."""
    return (100 + percent) * np.minimum(n_x - pos_x, n_y - pos_y) >= percent * (n_x + n_y)


def links(docs: DataFrame, table: DataFrame, percent=PERCENT, crowd=CROWD, rounds=ROUNDS):
    """(classes, links): class representatives by fingerprint, and links that connect what is linked.

    ``table`` holds ``signatures(docs)`` in storage.  The links are enough of all linked pairs to give the same
    components; pairs inside a component already found are not listed.
    """
    classes = materialise(table.filter("n > 0 and doc_id is not null").groupBy("print")
                          .agg(F.min("doc_id").alias("doc")), "classes")
    held = table.filter("n > 0 and doc_id is not null")
    copies = materialise(held.select("doc_id", "print").join(classes, "print").filter("doc_id <> doc").select("doc_id", "print"), "copies")
    kept = held.join(_checked(copies), ["doc_id", "print"], "left_anti").withColumnRenamed("doc_id", "doc")
    tiles, pieces = _postings(docs, kept.select("doc", "n", "head"), percent, crowd)
    sizes = held.select(F.col("doc_id").alias("doc"), "n", "bits")

    found, labelled, labels = None, tiles, None
    for round_ in range(rounds):
        pairs = labelled.transform(in_arrow, _led(round_, labels, percent), "a long, b long").distinct()
        new = _links(pairs, docs, sizes, percent)
        found = new if found is None else materialise(found.unionByName(new).distinct(), "links")
        labelled, labels = _labelled(tiles, components(found, "a", "b"), pieces)

    pairs = labelled.transform(in_arrow, _met(labels, percent, crowd), "a long, b long")
    marked = materialise(labelled.transform(in_arrow, _crowds(labels, percent, crowd),
                                            "h long, doc long, n long, place long, component long, role long"), "marked")
    if not marked.isEmpty():
        sketches = held.select(F.col("doc_id").alias("doc"), "n", "sketch")
        pairs = pairs.unionByName(_crowded_pairs(marked, sketches, percent))
    last = _links(pairs.distinct(), docs, sizes, percent)
    return classes, found.unionByName(last).distinct()


def near_duplicates(docs: DataFrame, percent=PERCENT, crowd=CROWD, rounds=ROUNDS) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id; one row per row of ``docs``.

    class_id is the smallest doc_id with an equal set, component_id the smallest doc_id reachable by links.
    Null or wordless text: 0 shingles, alone in its component.  Rows with the same doc_id are one document, so
    they share a component.  A null doc_id takes no part and has a null component.  An empty table gives an empty
    result; other columns are ignored.
    """
    table = materialise(signatures(docs, percent), "signatures")
    classes, found = links(docs, table, percent, crowd, rounds)
    merged = components(found, "a", "b").withColumnRenamed("node", "class_id")
    rows = table.select("doc_id", "n", "print").join(classes.withColumnRenamed("doc", "class_id"), "print", "left")
    return rows.join(merged, "class_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; all columns are kept.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id one stays: the first by text.
    """
    found, name = near_duplicates(docs, **options), free_name(docs, "other_doc")
    gone = found.filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    gone = materialise(gone, "gone")
    kept = docs.join(_checked(gone), docs["doc_id"].cast("long") == F.col(name), "left_anti")     # few ids: texts are not moved
    twice = (found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias("rows"))
             .filter("rows > 1").select(name))
    twice = materialise(twice, "repeated")
    if twice.isEmpty():
        return kept
    id_ = kept["doc_id"].cast("long")
    repeated = kept.join(twice, id_ == F.col(name), "left_semi")
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    single = repeated.select(*repeated.columns, row.alias(name)).filter(F.col(name) == 1).select(*repeated.columns)
    return kept.join(twice, id_ == F.col(name), "left_anti").unionByName(single)
