"""Quality by compression: dictionaries of good and of bad text.

A text that is like the good training texts compresses better with their dictionary than with the bad ones'.  The
difference of the two sizes per source byte, with the size under either, becomes a probability through logistic
regression, fitted on labelled rows that built neither dictionary.  Texts are compressed in blocks of ``BLOCK``
bytes, so the dictionary counts as much at the end of a long text as at its start.

Training takes at most ``TRAIN_DOCS`` labelled rows of either label, chosen by a hash of the id, and a stretch of
``TRAIN_CHARS`` characters of each.  Scoring takes whole texts.
"""

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import fold, in_arrow, slices
from .sampling import thinned, window_of

TRAIN_DOCS = 1500
TRAIN_CHARS = 1500
DICTIONARY = 96 << 10
BLOCK = 4096
LEVEL = 3
THRESHOLD = 0.3
FEATURES = 5


class Scorer:
    """Two dictionaries and the calibration; small, so it travels with the tasks."""

    def __init__(self, good: bytes, bad: bytes, weights=None, constant=None):
        self.good, self.bad, self.weights, self.constant = good, bad, weights, constant

    def opened(self):
        def compressor(raw):
            data = zstandard.ZstdCompressionDict(raw) if raw else None
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)
        return compressor(self.good), compressor(self.bad)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -700, 700)))


def features_of(raw: bytes, good, bad) -> list:
    """Calibration features of one text."""
    n = len(raw)
    g = b = 0
    for at in range(0, n, BLOCK):
        block = raw[at:at + BLOCK]
        g += len(good.compress(block))
        b += len(bad.compress(block))
    return [1.0, 10 * (b - g) / (n + 1), g / (n + 1), min(g, b) / (n + 1), math.log1p(n) / 10]


def dictionary(texts: list) -> bytes:
    """A zstandard dictionary from whole texts; too few of them serve as raw content."""
    samples = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def calibrated(x: np.ndarray, y: np.ndarray, rounds=50, ridge=1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(good: list, bad: list) -> Scorer:
    """From labelled texts as bytes: every other text builds the dictionaries, the rest calibrates."""
    if not good or not bad:
        return Scorer(b"", b"", constant=1.0 if good or not bad else 0.0)
    scorer = Scorer(dictionary(good[::2]), dictionary(bad[::2]))
    compressors = scorer.opened()
    rest = [(t, 1.0) for t in good[1::2]] + [(t, 0.0) for t in bad[1::2]]
    if not rest:
        rest = [(good[0], 1.0), (bad[0], 0.0)]
    x = np.array([features_of(t, *compressors) for t, _ in rest])
    scorer.weights = calibrated(x, np.array([v for _, v in rest]))
    return scorer


def train(docs: DataFrame, labels: DataFrame, per_label=TRAIN_DOCS, chars=TRAIN_CHARS, held_out=0) -> Scorer:
    """The scorer from rows labelled 0 or 1 whose fold is not ``held_out``; conflicting labels of an id are left out."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .filter("doc_id is not null and label in (0, 1)").filter(fold(F.col("doc_id")) != held_out)
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
             .filter("label = other").select("doc_id", "label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    got = {0: [], 1: []}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    wanted = None
    for label in sorted(counts):
        part = thinned(marks.filter(F.col("label") == label), F.col("doc_id"), per_label, counts[label])
        wanted = part if wanted is None else wanted.unionByName(part)
    if wanted is not None:
        picked = texts.join(F.broadcast(wanted), "doc_id")     # about 2 * per_label rows at most
        rows = picked.select("label", "doc_id", window_of(F.col("text"), F.col("doc_id"), chars).alias("text")).collect()
        for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
            got[r["label"]].append(r["text"].encode("utf-8", "surrogatepass"))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    scorer = fit(got[1], got[0])
    if scorer.weights is not None and got[1] and got[0]:
        # the sample is balanced, the labels are not: move the intercept to their share
        sampled = len(got[1]) / (len(got[1]) + len(got[0]))
        if 0 < share < 1:
            scorer.weights[0] += math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
    return scorer


def _scored(scorer):
    def run(batches):
        good, bad = scorer.opened()
        for batch in slices(batches):
            rows = batch.column(1).cast(pa.binary()).to_pylist()
            scores = scorer.score(np.array([features_of(r or b"", good, bad) for r in rows]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
    return run


def scores(docs: DataFrame, labels: DataFrame, held_out=0, threshold=THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null text counts as empty and gets the score of an empty text; a null doc_id is kept and counts as held out;
    repeated rows get equal results; an empty table gives an empty one; other columns are ignored.  Labels of one
    kind only, or none, give a constant score (1 without bad labels, else 0).
    """
    scorer = train(docs, labels, held_out=held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_arrow, _scored(scorer), "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id")) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
