"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags tokens as secret begin, inside or outside from their shape, their neighbours and features of the
file, decoded by Viterbi.  It learns from the spans that the patterns find: the whole table is looked through, and
``TRAIN_WINDOWS`` of the rows with a finding and as many of those without, chosen by a hash of the id, give a window
each, around a finding or elsewhere.  So that it does not depend on the key words that the patterns need, every finding
is also shown with its key word replaced.

Spans count code points of the text, end exclusive.
"""

import bisect
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from . import crf
from .common import in_arrow, slices

# fixed patterns: kind, expression, group to measure, least length
KEY_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "secret")     # ``secret``: spans of the field
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

_ASSIGN, _ACCESS, _HEX, _TOKEN = re.compile(ASSIGN, re.A), re.compile(ACCESS), re.compile(HEX), re.compile(r"\S+")
_KEY_WORD = re.compile("|".join(KEY_WORDS), re.I | re.A)

TRAIN_WINDOWS = 600      # windows of either sort at most
WINDOW_CHARS = 800
LABELS = ("O", "B", "I")
LEAST_CHARS = 12         # tokens of this length or more have features of keys


def base_spans(text: str) -> list:
    """(kind, start, end) of the fixed patterns, in order of start, then of kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SHAPES = [(re.compile("[A-Z]+"), "X"), (re.compile("[a-z]+"), "x"), (re.compile("[0-9]+"), "9"), (re.compile(r"[^\x00-\x7f]+"), "u")]


def token_features(token: str) -> list:
    """Shape, length, alphabet, spread of characters, affixes; nothing of the file."""
    core = token.strip("\"'`,;()[]{}<>")
    out = ["bias", "n=" + str(min(12, len(core).bit_length() * 2 + (len(core) & (len(core) >> 1) > 0)))]
    if len(core) < LEAST_CHARS and core.isascii() and core.isalpha() and (core[1:].islower() or len(core) == 1):
        # a plain word, perhaps with signs around it, needs no closer look
        shape = token.replace(core, "Xx" if core[0].isupper() else "x", 1)
        return [*out, "shape=" + shape[:24], "w=" + token.lower(), "end=" + token[-1], *["sign" + c for c in "=:\"'@/_-+." if c in token]]
    shape = token
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    digits, letters = sum(map(str.isdigit, core)), sum(map(str.isalpha, core))
    out.append("shape=" + shape[:24])
    if digits:
        out.append("digits" + ("+letters" if letters else ""))
    if digits and letters and len(core) >= LEAST_CHARS:
        counts = [core.count(c) for c in set(core)]
        spread = -sum(c / len(core) * math.log2(c / len(core)) for c in counts)
        out += ["mixed", "spread=" + str(int(spread * 2)), "switch=" + str(min(8, len(shape) // 4))]
    if re.fullmatch(r"[0-9a-f]{12,}", core):
        out.append("hex")
    if re.fullmatch(r"[A-Za-z0-9+/_=.-]{12,}", core):
        out.append("base64")
    if len(token) < 24:
        out += ["w=" + token.lower(), "end=" + token[-1]]
    out += ["sign" + c for c in "=:\"'@/_-+." if c in token]
    return out


def file_features(text: str) -> tuple:
    """What kind of file it is: coarse shares of code signs, line ends and digits."""
    n = len(text) + 1
    share = lambda c: str(min(5, int(math.log2(1 + 4096 * text.count(c) / n)) // 2))
    return tuple(f"{name}={share(c)}" for name, c in (("eq", "="), ("brace", "{"), ("semi", ";"), ("quote", '"'), ("line", "\n")))


def _tagged(text):
    """Tokens and their tags from the fixed patterns."""
    spans = base_spans(text)
    tokens, tags, last, at = [], [], None, 0
    for m in _TOKEN.finditer(text):
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        k = at
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        hit = spans[k] if k < len(spans) and spans[k][1] < m.end() else None
        tokens.append(m[0])
        tags.append(0 if hit is None else 2 if hit is last else 1)    # a secret next to another begins anew
        last = hit
    return tokens, tags, file_features(text)


def window(text, spans, place, chars):
    """``chars`` characters around one of ``spans``; without any, around a key word or anywhere; ``place`` chooses."""
    if spans:
        at = spans[place % len(spans)][1] - chars // 2
    else:
        word = _KEY_WORD.search(text) if place % 2 else None    # prose that names secrets without holding one
        at = word.start() - chars // 2 if word else (place >> 1) % max(1, len(text) - chars + 1)
    at = max(0, at)
    return text[at:at + chars]


def _windows(limit, chars):
    """Of a task's rows with a finding, and of those without, the windows of the ``limit`` smallest hashes; the first
    window of either sort brings the number of its rows."""
    def run(batches):
        kept, worst, total = {True: [], False: []}, {}, {True: 0, False: 0}
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text)
                hit = bool(spans)
                total[hit] += 1
                if key > worst.get(hit, key):
                    continue
                kept[hit].append((key, window(text, spans, key & 0x7FFFFFFF, chars)))
                if len(kept[hit]) >= 2 * limit:
                    kept[hit] = sorted(kept[hit])[:limit]
                    worst[hit] = kept[hit][-1][0]
        for hit, found in kept.items():
            found = sorted(found)[:limit]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hit] * len(found), pa.bool_()), pa.array([k for k, _ in found], pa.int64()),
                 pa.array([w for _, w in found], pa.string()), pa.array(([total[hit]] + [0] * len(found))[:len(found)], pa.int64())],
                names=["hit", "key", "text", "total"])
    return run


def train(docs: DataFrame, windows=TRAIN_WINDOWS, chars=WINDOW_CHARS):
    """The field, or None if no row holds a secret."""
    texts = docs.select(F.xxhash64("doc_id", F.lit(3)).alias("key"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # a task writes ``windows`` rows of either sort at most, whatever it reads; keys are even, so the share of them below
    # a limit is known beforehand, and little more than ``windows`` rows of a sort leave the executors
    cut = materialise(texts.transform(in_arrow, _windows(windows, chars), "hit boolean, key long, text string, total long"), "windows")
    totals = {r["hit"]: r["total"] for r in cut.groupBy("hit").agg(F.sum("total").alias("total")).collect()}
    rows = []
    for hit, total in totals.items():
        share = min(1.0, 1.2 * (windows + 50) / max(total, 1))
        near = cut.filter((F.col("hit") == hit) & (F.col("key") <= int((share * 2 - 1) * (2 ** 63 - 1025))))
        rows += sorted(near.collect(), key=lambda r: (r["key"], r["text"]))[:windows]
    sequences, any_ = [], False
    for r in sorted(rows, key=lambda r: (not r["hit"], r["text"])):
        tokens, tags, file = _tagged(r["text"])
        sequences.append((tokens, tags, file))
        if any(tags):
            any_ = True
            hidden = re.sub("|".join(KEY_WORDS), "value", r["text"], flags=re.I | re.A)
            if len(other := hidden.split()) == len(tokens):
                sequences.append((other, tags, file))
    return crf.train(sequences, LABELS, token_features, rounds=40, buckets=1 << 14) if any_ else None


def _field_spans(text, tags, base):
    """Spans of tagged token runs that touch no pattern's span."""
    out, run = [], []
    tokens = list(_TOKEN.finditer(text))
    starts, reach = [s[1] for s in base], list(itertools.accumulate((s[2] for s in base), max))

    def close():
        if run:
            start, end = run[0].start(), run[-1].end()
            while start < end and text[start] in "\"'`,;()[]{}<>":
                start += 1
            while end > start and text[end - 1] in "\"'`,;()[]{}<>.":
                end -= 1
            k = bisect.bisect_left(starts, end)
            if start < end and not (k and reach[k - 1] > start):
                out.append(("secret", start, end))
            run.clear()

    for m, tag in zip(tokens, tags):
        if tag != 2:
            close()
        if tag:
            run.append(m)
    close()
    return out


def _found(model):
    def run(batches):
        lexicon = crf.Lexicon(model, token_features) if model else None
        for batch in slices(batches, 1 << 20):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            every = [base_spans(t) for t in texts]
            more = [[] for _ in texts]
            if model:
                lexicon = lexicon.renewed()
                ids, edges = [], [0]
                for t in texts:
                    ids += [lexicon[w] for w in t.split()]
                    edges.append(len(ids))
                ids, edges = np.array(ids, np.int64), np.array(edges, np.int64)
                if len(ids):
                    scores = crf.emissions(lexicon.scored(), ids, edges)
                    added = np.array([crf.context_scores(lexicon, file_features(t)) for t in texts])
                    scores += np.repeat(added, np.diff(edges), axis=0)
                    tags = crf.viterbi(model, scores, crf.segments(edges))
                    marks = np.concatenate(([0], np.cumsum(tags > 0)))
                    for i in np.flatnonzero(marks[edges[1:]] > marks[edges[:-1]]):
                        more[i] = _field_spans(texts[i], tags[edges[i]:edges[i + 1]], every[i])
            joined = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in every]
            counts = [[sum(s[0] == kind for s in e) for e in every] for kind in KINDS[:3]]
            spans = [",".join(f"{k}:{a}:{b}" for k, a, b in sorted(e + m, key=lambda s: (s[1], KINDS.index(s[0]))))
                     for e, m in zip(every, more)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Null text counts as empty; a null doc_id is kept; repeated rows get equal results; an empty table gives an empty
    one; other columns are ignored.  If no row holds a pattern there is nothing to learn from, and only the (empty)
    pattern spans are given.
    """
    model = train(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow,
        _found(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
