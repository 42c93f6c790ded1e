"""Language identification: a linear-chain conditional random field labels every word.

Words are runs of letters.  Features of a word are its affixes, character n-grams and, as lexicon, the word itself;
transitions between the languages of neighbouring words are learned with them.  Forward-backward gives the
probability of every language at every word, so code-switched texts get a mixture; a document's language is the one
with the largest mean.

Training takes at most ``TRAIN_DOCS`` labelled rows per language, chosen by a hash of the id, and a stretch of
``TRAIN_CHARS`` characters of each.  Words of these with their letters shuffled stand for what is no known language, and
chains joined from stretches of all of them show the field how texts switch.  Prediction takes whole texts.
"""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import crf
from .common import fold, free_name, in_arrow, slices
from .sampling import thinned_by, window_of

TRAIN_DOCS = 500
TRAIN_CHARS = 500
UNKNOWN = "und"
REJECT_FROM = 0.3        # share of no known language from which a document goes; figures of held-out text in the README
SWITCHES = 4             # stretches of a mixed training chain
STRETCH = (3, 25)        # words of a stretch


def _members(categories) -> str:
    """Ranges of a character class: all characters of some Unicode categories."""
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) in categories]
    out = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_LETTER = r"[^\W\d_" + _members(("Nl", "No")) + "]"     # \w also holds numerals such as fractions and Roman numbers
_LETTERS = re.compile(f"{_LETTER}+(?:[{_members(('Mn', 'Mc', 'Me'))}]+{_LETTER}*)*")


_LATIN = re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+")    # the same where no character lies beyond Latin-1


def letter_words(text: str) -> list:
    """Runs of letters, with the marks that combine with them, lower-cased."""
    low = text.lower()
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        return _LETTERS.findall(low)
    return _LATIN.findall(low)


def word_features(word: str) -> list:
    """Affixes, character n-grams, lexicon entry."""
    framed = f"^{word}$"
    out = ["bias", "w=" + word, "p=" + word[:2], "s=" + word[-2:], "s=" + word[-1]]
    out += [framed[i:i + 2] for i in range(len(framed) - 1)]
    out += [framed[i:i + 3] for i in range(len(framed) - 2)]
    return out


def shuffled(word: str, rng) -> str:
    """The word's letters in another order."""
    return "".join(rng.sample(word, len(word)))


def mixed(pool: dict, labels: list, rng) -> tuple:
    """(words, labels) of a chain joined from stretches of texts of any language."""
    words, tags = [], []
    for _ in range(SWITCHES):
        lang = rng.choice(sorted(pool))
        text, size = rng.choice(pool[lang]), rng.randint(*STRETCH)
        at = rng.randrange(max(1, len(text) - size + 1))
        words += text[at:at + size]
        tags += [labels.index(lang)] * len(text[at:at + size])
    return words, tags


def train(docs: DataFrame, per_language=TRAIN_DOCS, chars=TRAIN_CHARS, held_out=0):
    """A model from rows with a language whose fold is not ``held_out``; None if there are none."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")) \
        .filter((fold(F.col("doc_id")) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    if not counts:
        return None
    sample = thinned_by(rows, F.col("lang"), F.col("doc_id"), per_language, dict(counts))
    got = sample.select("lang", window_of(F.col("text"), F.col("doc_id"), chars).alias("text")).collect()
    labels = [lang for lang, _ in counts]
    rng = random.Random(len(got))
    pool = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["text"])):
        if words := letter_words(r["text"]):
            pool.setdefault(r["lang"], []).append(words)
    strange = [[shuffled(w, rng) for w in words] for lang in sorted(pool) for words in pool[lang][::len(labels)]]
    if strange:
        pool.setdefault(UNKNOWN, []).extend(strange)
    if UNKNOWN not in labels:
        labels.append(UNKNOWN)
    sequences = [(words, [labels.index(lang)] * len(words), ()) for lang in sorted(pool) for words in pool[lang]]
    sequences += [(*mixed(pool, labels, rng), ()) for _ in range(len(sequences) // 2)]
    return crf.train(sequences, labels, word_features, neighbours=False)


MIXTURE = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def _label(model, names_out):
    def run(batches):
        known = [i for i, lang in enumerate(model.labels) if lang != UNKNOWN] or [0] if model else []
        lexicon = crf.Lexicon(model, word_features) if model else None
        for batch in slices(batches, 1 << 20):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            names, scores, mixtures = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if model:
                lexicon = lexicon.renewed()
                ids, edges = [], [0]
                for t in texts:
                    if t:
                        ids += [lexicon[w] for w in letter_words(t)]
                    edges.append(len(ids))
                ids, edges = np.array(ids, np.int64), np.array(edges, np.int64)
                if len(ids):
                    marginal = crf.forward_backward(model, crf.emissions(lexicon.scored(), ids, edges), crf.segments(edges))
                    full = np.flatnonzero(np.diff(edges))
                    share = np.add.reduceat(marginal, edges[:-1][full], axis=0) / np.diff(edges)[full, None]
                    for at, p in zip(full, share):
                        p = np.minimum(p, 1).tolist()
                        best = max(known, key=p.__getitem__)
                        names[at], scores[at] = model.labels[best], p[best]
                        mixtures[at] = [{"lang": lang, "share": share} for lang, share in zip(model.labels, p)]
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, MIXTURE)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names_out])
    return run


def labelled(df: DataFrame, model, names=("lang_pred", "score", "mixture")) -> DataFrame:
    """``df`` with the predicted language of its ``text``, that language's mean probability, and those of all languages.

    The mixture has the share of every language, and under ``und`` that of words of no known language; the prediction is the
    largest of the languages.  Null text, or text without a letter: ``und``, 0 and an empty mixture.  Without a model (no labelled
    rows) the same for all rows.  Every row is judged alone; repeated rows get equal results and an empty table gives an empty one.
    """
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))
    more = [T.StructField(name, kind) for name, kind in zip(names, kinds)]
    return df.transform(in_arrow, _label(model, names), T.StructType([*df.schema.fields, *more]))


def predictions(docs: DataFrame, held_out=0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture of every row; a null doc_id counts as held out."""
    model = train(docs, held_out=held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == held_out).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return labelled(rows, model).drop("text")


def accepted(docs: DataFrame, reject_from=REJECT_FROM) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known: not ``und``, and words of no known language short of the limit."""
    names = tuple(free_name(docs, name) for name in ("lang_pred", "score", "mixture"))
    rows = labelled(docs, train(docs), names)
    strange = F.aggregate(F.filter(names[2], lambda m: m["lang"] == UNKNOWN), F.lit(0.0), lambda total, m: total + m["share"])
    return rows.filter((F.col(names[0]) != UNKNOWN) & (strange < reject_from)).drop(*names)
