"""Personal data: fixed patterns, and offset-preserving deobfuscation for what hides from them.

A chain of transducers rewrites a text: character references and look-alike characters to ASCII, invisible ones to
nothing, spelled digits to digits, at/dot disguises to signs.  Every character of the result knows the source characters it stands for, so a
finding in the rewritten text maps back to a span of the source.  A cheap test per transducer decides whether it
could change the text at all.

Spans count code points of the text, end exclusive.
"""

import bisect
import hashlib
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, slices

# fixed patterns; phone and card lengths count digits
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")   # inside a run of digits it would match from its start
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_ANY_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _emails(text):
    """Leftmost, non-overlapping: the run of local characters before each ``@`` with a domain."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            free = m.end()


def base_spans(text: str) -> list:
    """(kind, start, end) of the fixed patterns, in order of start, then of kind."""
    out = list(_emails(text)) if "@" in text else []
    if _ANY_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(_octet(p) for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Tape:
    """A rewritten text; character i stands for source characters [starts[i], ends[i])."""

    def __init__(self, text, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def source(self, start, end):
        return self.starts[start], self.ends[end - 1]

    def rewritten(self, pattern, replace):
        """Matches of ``pattern`` replaced by ``replace(match)``: a list of (char, start, end) in this tape, or None."""
        text, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            parts = replace(m)
            if parts is None:
                continue
            text.append(self.text[at:m.start()])
            starts.extend(self.starts[at:m.start()])
            ends.extend(self.ends[at:m.start()])
            for char, a, b in parts:
                text.append(char)
                starts.append(self.starts[a])
                ends.append(self.ends[b - 1])
            at = m.end()
        if not at:
            return self
        text.append(self.text[at:])
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        return Tape("".join(text), starts, ends)


# look-alikes of ASCII letters: Cyrillic and Greek letters, each with the letter it looks like
LOOK_ALIKES = dict(zip("аесорхуіјѕԁһАВЕКМНОРСТХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aecopxyijsdhABEKMHOPCTXIJSaopvikABEZHIKMNOPTYX"))
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "－": "-", "‐": "-", "‑": "-", "‒": "-",
         "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ", "（": "(", "）": ")"}
INVISIBLE = "­​‌‍⁠﻿"


# blocks of letters and digits in other shapes, which compatibility normalisation turns into plain ones
SHAPES = ((0x2100, 0x214F), (0x2460, 0x24FF), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x1F110, 0x1F189), (0x1FBF0, 0x1FBF9))
LATIN_ALIKES = dict(zip("ʝɑɡıȷʋɩⅼɴɪʀʏᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢ", "jagijvilniryacdejkmoptuvwz"))
LOOK_ALIKES.update(LATIN_ALIKES)


def _plain(c):
    """ASCII character that ``c`` stands for: '' for invisible ones, None if there is none."""
    if c in INVISIBLE:
        return ""
    if c in SIGNS or c in LOOK_ALIKES:
        return SIGNS.get(c) or LOOK_ALIKES.get(c)
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    d = unicodedata.decimal(c, None)
    if d is not None:
        return str(d)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and plain.isalnum() else None


_STRANGE = re.compile("[" + "".join(map(re.escape, [*SIGNS, *LOOK_ALIKES, *INVISIBLE]))
                      + "".join(f"{chr(a)}-{chr(b)}" for a, b in SHAPES) + "٠-٩۰-۹०-९০-৯]")


_REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|(commat|period|plus|nbsp|lpar|rpar));?")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "nbsp": " ", "lpar": "(", "rpar": ")"}


def references(tape):
    """Character references of HTML, for characters that are not controls."""
    if "&" not in tape.text:
        return tape

    def one(m):
        code = _NAMED.get(m[3]) or chr(min(int(m[1]) if m[1] else int(m[2], 16), 0x10FFFF))
        return [(code, m.start(), m.end())] if code.isprintable() else None
    return tape.rewritten(_REFERENCE, one)


def homoglyphs(tape):
    if tape.text.isascii():
        return tape

    def one(m):
        to = _plain(m[0])
        return None if to is None else [(to, m.start(), m.end())] if to else []
    return tape.rewritten(_STRANGE, one)


# digits spelled in English, German, French and Spanish
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_POINT = "point|dot|punkt|punto"
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
# a run of four or more spelled or plain digits that starts with a spelled one
_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[\s-]+)?(?:{_WORD})(?:[\s,-]+(?:(?:{_POINT})[\s-]+)?(?:{_WORD}|[0-9]{{1,19}})(?!\w)){{3,}}")
_PART = re.compile(rf"(?i)(?<!\w)(?:plus|{_POINT}|{_WORD}|[0-9]+)(?!\w)")
# a spelled number needs no country code where a word asks to call it
_CALL = re.compile(r"(?i)(?<!\w)(?:call|dial|ring|phone|tel|telephone|mobile|text|sms|fax|number|whatsapp|ruf|rufen|telefon|nummer|handy|"
                   r"appelez|appeler|tél|téléphone|numéro|llama|llame|llamar|teléfono|número)[^\w\n]{1,3}(?:\w{1,9}[^\w\n]{1,3}){0,3}$")


def spelled_digits(tape, called):
    """Spelled digits as digits; ``called`` gets the source spans of numbers that the text asks to call."""
    def one(m):
        out = []
        for w in _PART.finditer(m.string, m.start(), m.end()):
            word = w[0].lower()
            if word.isdigit():
                out += [(c, w.start() + i, w.start() + i + 1) for i, c in enumerate(word)]
            else:
                out.append(("+" if word == "plus" else str(SPELLED.get(word, ".")), w.start(), w.end()))
        if 7 <= len(out) <= 15 and all(c.isdigit() for c, _, _ in out) and _CALL.search(m.string, max(0, m.start() - 60), m.start()):
            called.append((tape.source(m.start(), m.start() + 1)[0], tape.source(m.end() - 1, m.end())[1]))
        return out
    return tape.rewritten(_RUN, one)


_AT = r"at|arroba|arobase|chez|klammeraffe|ät"
_BRACKETED = re.compile(rf"(?i)(?:(?<![ \t])[ \t]*|(?<=[ \t]))[\[({{<][ \t]*(?:({_AT}|@)|(dot|{_POINT}|\.))[ \t]*[\])}}>][ \t]*")
# a phrase without brackets counts only if it ends as addresses do
ENDINGS = "com|org|net|edu|gov|info|biz|io|dev|eu|us|uk|ca|au|de|at|ch|fr|be|es|mx|ar|it|nl|pl|br|in|jp|cn"
_DOT = rf"(?:\.|[ \t]+(?:{_POINT})[ \t]+)"
_LABELS = rf"[ \t]+[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*?{_DOT}(?:{ENDINGS})(?![\w-]|\.\w)"
_SPOKEN = re.compile(rf"(?i)(?<![\w.%+-])[a-z0-9._%+-]+[ \t]+(?:{_AT}){_LABELS}")
_SPOKEN_SIGN = re.compile(rf"(?i)[ \t]+(?:({_AT})|({_POINT}))[ \t]+")
# behind a sign any ending counts, unless the domain has one already
_AFTER_SIGN = re.compile(rf"(?i)@(?:[a-z0-9.-]+(?:[ \t]+(?:{_POINT})[ \t]+[a-z0-9-]+)*?[ \t]+(?:{_POINT})[ \t]+(?:{ENDINGS})"
                         rf"|[a-z0-9-]+[ \t]+(?:{_POINT})[ \t]+[a-z]{{2,24}})(?![\w-])")
# blanks around the signs themselves
_SPREAD = re.compile(rf"(?i)(?<![\w.%+-])([a-z0-9._%+-]+)[ \t]{{0,3}}@[ \t]{{0,3}}[a-z0-9-]+(?:[ \t]{{0,3}}\.[ \t]{{0,3}}[a-z0-9-]+)*?"
                     rf"[ \t]{{0,3}}\.[ \t]{{0,3}}(?:{ENDINGS})(?![\w-]|\.\w)")


_AT_WORD = re.compile(rf"(?i)[ \t](?:{_AT})[ \t]+[a-z0-9]")
_POINT_WORD = re.compile(rf"(?i)[ \t](?:{_POINT})[ \t]")
_BLANK_SIGN = re.compile(r"[ \t][@.]|[@.][ \t]")


def at_and_dot(tape):
    """``[at]``, ``(dot)``, spoken ``at`` before a domain with spoken or literal dots, and blanks around the signs."""
    if any(c in tape.text for c in "[({<"):
        tape = tape.rewritten(_BRACKETED, lambda m: [("@" if m[1] else ".", m.start(), m.end())])

    def phrase(m):
        out, at = [], m.start()
        for s in _SPOKEN_SIGN.finditer(m.string, m.start(), m.end()):
            out += [(c, at + i, at + i + 1) for i, c in enumerate(m.string[at:s.start()])]
            out.append(("@" if s[1] else ".", s.start(), s.end()))
            at = s.end()
        return out + [(c, at + i, at + i + 1) for i, c in enumerate(m.string[at:m.end()])]

    def close(m):
        return [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0]) if c not in " \t"]
    if _AT_WORD.search(tape.text):
        tape = tape.rewritten(_SPOKEN, phrase)
    if "@" in tape.text:
        if _POINT_WORD.search(tape.text):   # name@host dot org
            tape = tape.rewritten(_AFTER_SIGN, phrase)
        if _BLANK_SIGN.search(tape.text):
            tape = tape.rewritten(_SPREAD, lambda m: close(m) if " " in m[0] or "\t" in m[0] else None)
    return tape


def hidden_spans(text: str, base: list) -> list:
    """Findings of the rewritten text as spans of the source that reach beyond every span of ``base``."""
    called = []
    tape = spelled_digits(at_and_dot(homoglyphs(references(Tape(text)))), called)
    if tape.text == text:
        return []
    starts = [s[1] for s in base]
    reach = list(itertools.accumulate((s[2] for s in base), max))
    covered = lambda start, end: (k := bisect.bisect_right(starts, start)) > 0 and reach[k - 1] >= end
    out, last = [], 0
    for kind, a, b in base_spans(tape.text):
        start, end = tape.source(a, b)
        if kind == "email":   # letters with other marks or shapes in front belong to the name
            while start > last and not text[start - 1].isascii() and unicodedata.name(text[start - 1], "").startswith("LATIN"):
                start -= 1
            last = end
        if not covered(start, end):
            out.append((kind, start, end))
    phones = {(start, end) for kind, start, end in out if kind == "phone"}
    return out + [("phone", start, end) for start, end in called if not covered(start, end) and (start, end) not in phones]


def all_spans(text: str):
    """(spans of the patterns, all spans), both by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + hidden_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


def masked(text: str, spans) -> str:
    """The text with every span, overlapping ones merged, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(batches):
    for batch in slices(batches):
        rows = [all_spans(t or "") for t in batch.column(1).to_pylist()]
        counts = [[sum(s[0] == kind for s in base) for base, _ in rows] for kind in KINDS]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
             pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in rows], pa.string()),
             pa.array([_written(s) for _, s in rows], pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def search(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row.

    Null text counts as empty; a null doc_id is kept; repeated rows get equal results; an empty table gives an empty
    one; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow,
        _found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _masked(batches):
    for batch in slices(batches):
        at = batch.schema.get_field_index("text")
        texts = [t if t is None else masked(t, all_spans(t)[1]) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        size = batch.schema.get_field_index("n_chars")
        if size >= 0:
            columns[size] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[size].type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with all findings masked in ``text``; ``n_chars``, where there is one, follows the new text."""
    return docs.transform(in_arrow, _masked, docs.schema)
