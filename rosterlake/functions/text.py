"""Text scalars: defaults, first paragraph, redaction, truncation, tags."""

from functools import reduce

from pyspark.sql import Column, functions as F

from ..rules import signals
from . import regex

# what Go's TrimSpace and Java's default trim disagree on is limited to exotic
# blanks; these four plus the space cover the line formats that are read here
_BLANKS = " \t\n\r\f\x0b"


def trim_blank(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def nonblank(c: Column) -> Column:
    """NULL for blank strings, the string itself otherwise."""
    return F.when(trim_blank(c) != "", c)


def first_paragraph(text: Column) -> Column:
    """First line that is neither empty, a heading nor an image; NULL if none.

    The other lines are only looked at where the first one with characters is a heading or an image.
    """
    special = lambda s: F.startswith(s, F.lit("#")) | F.startswith(s, F.lit("!["))
    lines = F.transform(F.split(text, "\n"), trim_blank)
    wanted = F.filter(lines, lambda s: (s != "") & ~special(s))
    begun = F.ltrim(text, F.lit(_BLANKS))
    return F.when(special(begun), F.get(wanted, F.lit(0))) \
            .otherwise(F.nullif(F.rtrim(F.substring_index(begun, "\n", 1), F.lit(_BLANKS)), F.lit("")))


def describe(description: Column, readme: Column) -> Column:
    """Readme's first paragraph when there is one, else the given description."""
    return F.coalesce(first_paragraph(readme), trim_blank(or_empty(description)))


def redact(text: Column, phrases=signals.REDACT_PHRASES, mark="[REDACTED]") -> Column:
    # replacing compares at every byte; texts without a phrase, nearly all, are left as they are
    cleaned = reduce(lambda c, p: F.replace(c, F.lit(p), F.lit(mark)), phrases, text)
    return F.when(regex.contains_any(text, phrases), cleaned).otherwise(text)


def license_or_unknown(license_: Column) -> Column:
    return F.coalesce(nonblank(license_), F.lit("UNKNOWN"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def truncate(text: Column, limit: int, tail="...") -> Column:
    """Cut after ``limit`` characters, never inside one; ``limit=None`` keeps all."""
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(tail))) \
            .otherwise(text)


def table_cell(text: Column, limit: int) -> Column:
    """One-line table cell: escape bars, flatten newlines, then cut."""
    flat = F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return truncate(flat, limit)


def clean_description(text: Column, marks=signals.OBFUSCATION_MARKS, limit=None) -> Column:
    """Blank when it looks like obfuscated code, otherwise whole, or cut after ``limit`` characters."""
    return F.when(regex.contains_any(text, marks), F.lit("")).otherwise(truncate(text, limit, "…"))


def word_pattern(word: str) -> str:
    """Pattern of a whole word; ASCII word characters bound it."""
    esc = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in word)
    return f"(?<![A-Za-z0-9_]){esc}(?![A-Za-z0-9_])"


def content_key(text: Column) -> Column:
    """Stable short key for joining and de-duplicating matched text."""
    return F.left(F.sha2(text, 256), F.lit(16))
