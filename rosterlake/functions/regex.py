"""One pattern text, two dialects.

Pattern tables are written in RE2 syntax (what DuckDB and the original data
rules use).  ``jvm`` rewrites the few constructs that mean something else in
``java.util.regex``, so Spark's built-in regex functions give the same matches.
"""

from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F

_SPACE = r"\t\n\f\r "
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def _initials(pattern: str, at: int) -> str:
    """The first characters of the alternatives of the group at ``pattern[at]``, each once; "" where one of them does
    not begin with an ASCII letter or digit that has to occur."""
    if pattern[at:at + 1] != "(":
        return ""
    i = at + 3 if pattern.startswith("(?:", at) else at + 1
    out, depth, begins, in_class = [], 1, True, False
    while i < len(pattern):
        ch = pattern[i]
        if begins:
            if not (ch.isascii() and ch.isalnum()) or pattern[i + 1:i + 2] in tuple("?*{"):
                return ""
            out.append(ch)
            begins = False
        elif ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            # a leading ']' (after an optional '^') is a literal
            i += pattern.startswith("^", i + 1)
            i += pattern.startswith("]", i + 1)
        elif ch == "|" and depth == 1:
            begins = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
            if not depth:
                return "" if pattern[i + 1:i + 2] in tuple("?*{") else "".join(dict.fromkeys(out))
        i += 1
    return ""


def _boundary(pattern: str, at: int) -> str:
    """The boundary in front of ``pattern[at:]``.

    A plain character that has to follow, or one of a group's first characters, is looked for first, and tells on which
    side the word is: nearly all places of a text end at that character.
    """
    after, then = pattern[at:at + 1], pattern[at + 1:at + 2]
    group = _initials(pattern, at)
    if group and not ("(?i" in pattern and set(group) & set("sSkK")):
        return f"(?=[{group}])(?<!{_WORD})"
    # an optional character does not tell; the long s and the Kelvin sign fold to ASCII letters
    if not after or after in "\\[](){}.^$|?*+" or then in tuple("?*{") or "(?i" in pattern and after in "sSkKſ\u212a":
        return _BOUNDARY
    word = after.isascii() and (after.isalnum() or after == "_")
    return f"(?={after})(?<{'!' if word else '='}{_WORD})"


@lru_cache(maxsize=None)
def jvm(pattern: str) -> str:
    """RE2 pattern -> equivalent java.util.regex pattern."""
    out, i, in_class, multiline = [], 0, False, "(?m" in pattern
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{_SPACE}]")
            elif nxt == "b" and not in_class:
                out.append(_boundary(pattern, i + 2))
            elif nxt == "z":
                out.append("\\z")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
                out.append(ch)
            elif ch in "[&":
                out.append("\\" + ch)
            else:
                out.append(ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
            # a leading ']' (after an optional '^') is a literal
            j = i + 1
            if j < len(pattern) and pattern[j] == "^":
                out.append("^")
                j += 1
            if j < len(pattern) and pattern[j] == "]":
                out.append("\\]")
                j += 1
            i = j
            continue
        elif ch == "(" and (i == 0 or pattern[:i] == "(?i)") and _initials(pattern, i):
            # most places of a text end at the first character, before an alternative is tried
            out.append(f"(?=[{_initials(pattern, i)}])(")
        elif ch == "." :
            out.append("[^\\n]")
        elif ch == "$":
            out.append("$" if multiline else "\\z")
        elif pattern.startswith("(?i)", i):
            out.append("(?iu)")
            i += 4
            continue
        elif pattern.startswith("(?m)", i):
            out.append("(?md)")
            i += 4
            continue
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def matches(text: Column, pattern: str) -> Column:
    """True where the RE2 ``pattern`` occurs anywhere in ``text``."""
    return text.rlike(jvm(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(jvm(pattern)))


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(jvm(pattern)), F.lit(0))


def first(text: Column, pattern: str) -> Column:
    """The first match, NULL without one."""
    return F.regexp_substr(text, F.lit(jvm(pattern)))


def pieces(text: Column, pattern: str) -> Column:
    """Text between the matches; one element more than there are matches."""
    return F.split(text, jvm(pattern), -1)


def any_of(conditions) -> Column:
    """OR of a possibly empty list of conditions."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, needles) -> Column:
    return any_of([F.contains(text, F.lit(n)) for n in needles])


def fold_case(text: Column) -> Column:
    """Lower case, with the long s folded too, so that substring gates accept
    everything a case-insensitive pattern accepts."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))
