"""Helpers of the operators: tables, hash folds, and words of Arrow text columns as numpy arrays."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# bytes of a UTF-8 text handled at a time by the numpy helpers; a longer single text is one slice
SLICE_BYTES = 1 << 20
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def vocabulary(name="byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's vocabulary file, installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks held-out rows (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


BATCH = "4m"      # of Arrow data that a task hands to Python at a time
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with small batches, so that a task's memory does not depend on the length of texts.

    The setting is the session's, and is read when the plan runs.
    """
    df.sparkSession.conf.set(_BATCH_KEY, BATCH)
    return df.mapInArrow(fn, schema)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def slices(batches, max_bytes=SLICE_BYTES, column="text"):
    """Cuts record batches so that a piece holds about ``max_bytes`` of the text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + max_bytes, side="right")) - 1
            stop = min(max(stop, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def offsets_of(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string column, relative to its first row; nulls take no bytes."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    raw = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1] if col.buffers()[1] else np.zeros(len(col) + 1, kind)
    return raw.astype(np.int64)


def bytes_of(col: pa.Array):
    """(bytes of all rows, offsets of the rows in them)."""
    offsets = offsets_of(col)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def byte_set(spec) -> np.ndarray:
    """Truth table over the 256 byte values."""
    out = np.zeros(256, bool)
    out[list(spec)] = True
    return out


SPACE = byte_set([0x20, *range(0x09, 0x0E)])


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray):
    """Maximal runs of bytes outside ``breaks`` inside each row: (starts, ends, words per row)."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(breaks[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    if len(cut):  # a run ends with its row
        first[cut] |= inside[1:-1][cut]
        last[cut - 1] |= inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(lower=False) -> np.ndarray:
    """A fixed 64-bit code per byte value; ``lower`` gives A-Z the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


BASE = 0x5851F42D4C957F2D  # odd, so its powers can be inverted modulo 2**64


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHash:
    """64-bit hashes of byte ranges from one prefix sum of a polynomial modulo 2**64."""

    def __init__(self, lower=False):
        self.codes = byte_codes(lower)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data, starts, ends):
        if len(self.up) < len(data) + 1:
            n = max(len(data) + 1, SLICE_BYTES + (SLICE_BYTES >> 3))
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[:len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes, order-sensitive."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k:k + n] * np.uint64((0xD1342543DE82EF95 + 2 * 0x9E3779B97F4A7C15 * k) % (1 << 64) | 1)
    return mix(out)


def within(counts: np.ndarray, size: int):
    """Positions of all word windows that stay inside their row, and windows per row."""
    each = np.maximum(counts - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    base = np.repeat(first - np.concatenate(([0], np.cumsum(each)))[:-1], each)
    return base + np.arange(each.sum()), each


def list_array(flat: np.ndarray, counts: np.ndarray, kind=pa.int64()) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def bytes_array(data: np.ndarray, cuts: np.ndarray, given=None) -> pa.Array:
    """Binary column whose rows are the bytes of ``data`` between ``cuts``; null where ``given`` is false."""
    valid = None if given is None else pa.py_buffer(np.packbits(given, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [valid, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
