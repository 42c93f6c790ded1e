"""Quality rules under weak supervision.

Each rule votes good, bad or abstains.  Expectation-maximisation over the votes of the whole table estimates how often
each rule votes bad and how often good, among good documents and among bad ones, and the share of good documents within
bounds.  It starts from one accuracy per rule, estimated under a given share.  A rule that
mostly speaks alone decides, if others second it at times and hardly speak against it; one that fires beside good votes
loses weight, and one that nothing ever seconds stays open.  The posterior probability of a good document
decides, in place of a demand that all rules pass.  A table of vote patterns and their counts is all that the estimation needs:
it has at most 3 ** rules rows, whatever the corpus, and is the only thing that reaches the driver.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import SPACE, WordHash, byte_set, bytes_of, in_arrow, slices, spans, windows, within

REPEAT_WORDS = 5
SYMBOLS = byte_set(b"#*$%&|<>")
KEEP_FROM = 0.5          # posterior from which a document is kept
ROUNDS = 100
SETTLED = 1e-9
PRIOR = 0.8              # share of good documents
RIGHT = 0.8              # accuracy that a rule is expected to have
TRUST = 1.0              # weight of that expectation against the rule's own votes, per vote
LEAST, MOST = 0.5, 0.999  # a rule is taken to be no worse than chance, and never certain
GOOD_SHARE = (0.5, 0.95)  # bounds of the estimated share of good documents
EXPECTED = 2.0           # documents of either sort that the expectation of a rule's rates counts as

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha")


def _chars_in(data, starts, ends, counts, truth):
    """Per row: bytes inside words for which ``truth`` holds."""
    total = np.concatenate(([0], np.cumsum(truth)))
    per_word = total[ends] - total[starts]
    return _per_row(per_word, counts)


def _per_row(values, counts):
    edges = np.concatenate(([0], np.cumsum(counts)))
    total = np.concatenate(([0], np.cumsum(values)))
    return total[edges[1:]] - total[edges[:-1]]


def repeated_words(hashes, counts, size=REPEAT_WORDS):
    """Per row: words covered by windows of ``size`` words that occur twice or more in the row, first ones included."""
    at, each = within(counts, size)
    out = np.zeros(len(counts), np.int64)
    if not len(at):
        return out
    rows = np.repeat(np.arange(len(counts)), each)
    rolled = windows(hashes, size)[at]
    order = np.lexsort((rolled, rows))
    same = (rolled[order][1:] == rolled[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    again = np.zeros(len(at), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = at[order][again]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, np.minimum(hit + size, len(hashes)), -1)
    return _per_row(np.cumsum(edge)[:-1] > 0, counts)


def duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word, those of them that equal an earlier line)."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def measures(col: pa.Array, hasher: WordHash) -> dict:
    """Counts per row of a text column; a null has none."""
    data, offsets = bytes_of(col)
    starts, ends, counts = spans(data, offsets, SPACE)
    lead = (data & 0xC0) != 0x80          # first bytes of code points
    lines = [duplicate_lines(t) if t else (0, 0) for t in col.to_pylist()]
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    upper = (data >= 65) & (data <= 90)
    alpha = upper | ((data >= 97) & (data <= 122)) | (data >= 0xC0)
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": _chars_in(data, starts, ends, counts, lead),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.array([d for _, d in lines], np.int64),
        "n_repeat_words": repeated_words(hasher(data, starts, ends), counts),
        "n_lines": np.array([n for n, _ in lines], np.int64),
        "n_upper": _chars_in(data, starts, ends, counts, upper),
        "n_alpha": _chars_in(data, starts, ends, counts, alpha),
    }


def _measured(batches):
    hasher = WordHash()
    for batch in slices(batches):
        got = measures(batch.column(1), hasher)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[m], pa.int64()) for m in MEASURES)],
                                         names=["doc_id", *MEASURES])


# (name, condition to vote bad, condition to vote good); neither holds: the rule abstains.  Integer arithmetic only.
# Most rules know one fault each and are silent otherwise; ``prose`` speaks for texts without any.
RULES = (
    ("length", "n_words < 10", "false"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "false"),
    ("symbols", "10 * n_symbols > n_words", "false"),
    ("lines", "100 * n_dup_lines > 30 * n_lines", "false"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", "false"),
    ("letters", "100 * n_alpha < 75 * word_chars", "false"),
    ("capitals", "100 * n_upper > 30 * n_alpha", "false"),
    ("prose", "false", "n_words >= 50 and 100 * n_repeat_words <= 5 * n_words and 100 * n_symbols <= n_words and "
     "100 * n_dup_lines <= 5 * n_lines and 100 * n_alpha >= 85 * word_chars and 100 * n_upper <= 15 * n_alpha"),
)


def votes(rules=RULES) -> list[Column]:
    """One column per rule: 1 good, -1 bad, 0 abstains."""
    return [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"vote_{name}") for name, bad, good in rules]


def estimate(patterns, counts, prior=PRIOR, rounds=ROUNDS):
    """How often each rule's votes are right, given the share of good documents.

    ``patterns``: distinct vote tuples; ``counts``: documents with each.  Votes are independent given the sort of
    document, and whether a rule votes at all says nothing about it.
    """
    patterns, counts = np.asarray(patterns, np.int64).reshape(len(counts), -1), np.asarray(counts, float)
    accuracy = np.full(patterns.shape[1], RIGHT)
    for _ in range(rounds):
        good = posterior(patterns, prior, accuracy)
        before = accuracy
        right = ((patterns == 1) * good[:, None] + (patterns == -1) * (1 - good)[:, None]) * counts[:, None]
        cast = (patterns != 0) * counts[:, None]
        cast = cast.sum(axis=0)
        own = np.where(cast > 0, right.sum(axis=0) / np.maximum(cast, 1e-9), RIGHT)    # a silent rule is as expected
        accuracy = np.clip((own + TRUST * RIGHT) / (1 + TRUST), LEAST, MOST)
        if np.abs(accuracy - before).max() < SETTLED:
            break
    return accuracy


def posterior(patterns, prior, accuracy):
    """Probability of a good document for each vote tuple."""
    odds = math.log(prior / (1 - prior)) + np.asarray(patterns) @ np.log(accuracy / (1 - accuracy))
    return 1 / (1 + np.exp(-odds))


def vote_weights(patterns, counts, prior=PRIOR, rounds=ROUNDS):
    """(share of good documents, log odds of good that each rule's votes -1, 0, 1 carry).

    A rule has a rate of bad votes and one of good votes in either sort of document, drawn towards the rule's rates in
    the whole table, tilted by ``RIGHT``, with the weight of ``EXPECTED`` documents.  Abstaining carries nothing.
    """
    patterns, counts = np.asarray(patterns, np.int64).reshape(len(counts), -1), np.asarray(counts, float)
    good = posterior(patterns, prior, estimate(patterns, counts, prior, rounds))
    cast = np.stack([patterns == -1, patterns == 1], axis=2)
    all_ = np.einsum("p,prv->rv", counts, cast) / counts.sum()
    tilt = 2 * np.array([1 - RIGHT, RIGHT])
    most = math.log(MOST / (1 - MOST))
    for _ in range(rounds):
        in_good = np.einsum("p,prv->rv", counts * good, cast) + EXPECTED * all_ * tilt
        in_bad = np.einsum("p,prv->rv", counts * (1 - good), cast) + EXPECTED * all_ * (2 - tilt)
        n_good, n_bad = (counts * good).sum() + EXPECTED, (counts * (1 - good)).sum() + EXPECTED
        odds = np.log(np.where(all_ > 0, in_good, 1) / np.where(all_ > 0, in_bad, 1) * np.where(all_ > 0, n_bad / n_good, 1))
        weights = np.zeros((patterns.shape[1], 3))
        weights[:, 0], weights[:, 2] = np.clip(odds[:, 0], -most, 0), np.clip(odds[:, 1], 0, most)
        prior = float(np.clip((counts * good).sum() / counts.sum(), *GOOD_SHARE))
        total = math.log(prior / (1 - prior)) + np.take_along_axis(weights, patterns.T + 1, axis=1).sum(axis=0)
        before, good = good, 1 / (1 + np.exp(-total))
        if np.abs(good - before).max() < SETTLED:
            break
    return prior, weights


def judged(docs: DataFrame, rules=RULES, prior=PRIOR, keep_from=KEEP_FROM) -> DataFrame:
    """doc_id, counts, base_failed, kept, p_good and the votes; one row per row of ``docs``.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated windows.  Such documents are not kept;
    the others are kept if the posterior is at least ``keep_from``.  Null text has no words; a null doc_id is kept;
    repeated rows count each and get equal results; an empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialise(rows.transform(in_arrow, _measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)), "measures")
    named = [f"vote_{name}" for name, _, _ in rules]
    voted = table.select("*", *votes(rules))
    found = voted.groupBy(*named).count().collect()       # at most 3 ** rules rows
    p_good = F.lit(prior)
    if found:
        found = sorted(tuple(r) for r in found)
        patterns = [r[:-1] for r in found]
        share, weights = vote_weights(patterns, [r[-1] for r in found], prior)
        odds = F.lit(math.log(share / (1 - share)))
        for name, (bad, _, good) in zip(named, weights.tolist()):
            odds = odds + F.when(F.col(name) == -1, bad).when(F.col(name) == 1, good).otherwise(0.0)
        p_good = 1 / (1 + F.exp(-odds))
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & (p_good >= keep_from)).alias("kept"), p_good.alias("p_good"), *named)
