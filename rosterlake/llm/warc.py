"""Derivative records of web archives: metadata and plain-text conversions of response records.

A response is a row: record_id, target_uri, date, block (HTTP status line, headers, empty line, body).  Each gives
two records that refer to it: ``metadata`` (application/warc-fields: status, source headers, title, language, links)
and ``conversion`` (text/plain: the page's text).  Identifiers are derived from the response's, so a repeated build
gives the same records.  All of it is column expressions: one pass over the responses, no shuffle.
"""

import html
from html import entities

from pyspark.sql import Column, DataFrame, functions as F

SOFTWARE = "derivative-builder/1.0"
NEWLINE = "\r\n"

# markup to text; patterns are kept to what regular expression dialects agree on
DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<nav\b.*?</nav\s*>"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|footer|header|title|blockquote|pre)\b[^>]*>"
TAGS = r"(?s)<[^>]*>"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# what HTML reads into a reference: its named characters, a no-break space as a blank; numbers that stand for no character
# of their own, among them those of an old code page
NAMES = {**{name: char for name, char in entities.html5.items() if name.endswith(";")}, "nbsp;": " "}
NUMBERS = {code: html.unescape(f"&#{code};") for code in (0, *range(0x80, 0xA0)) if html.unescape(f"&#{code};") != chr(code)} | {160: " "}
LONG = 1 << 16       # bytes from which openers that nothing closes are set aside
_ASIDE = "\ue000"


def _literal_map(table: dict) -> Column:
    quoted = lambda s: "'" + str(s).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(quoted(x) for pair in table.items() for x in pair) + ")")


def _character(reference: Column) -> Column:
    """The text that one reference stands for; an unknown name stays as it is."""
    body = F.substr(reference, F.lit(2))
    number = F.when(body.rlike("^#[xX]"), F.conv(F.regexp_extract(body, "^#[xX]([0-9A-Fa-f]+)", 1), 16, 10)) \
        .when(body.startswith("#"), F.regexp_extract(body, "^#([0-9]+)", 1)).cast("long")
    wrong = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    numeric = F.when(wrong, "\ufffd").otherwise(F.coalesce(F.try_element_at(_literal_map(NUMBERS), number.cast("string")), point))
    return F.when(number.isNull(), F.coalesce(F.try_element_at(_literal_map(NAMES), body), reference)).otherwise(numeric)


def _with(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used: as the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unescaped(text: Column) -> Column:
    """Character references undone, once; named ones end in a semicolon."""
    def undone(t):
        found = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), _character)
        joined = F.array_join(F.zip_with(F.split(t, REFERENCE, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(t.contains("&"), joined).otherwise(t)
    return _with(text, undone)


def _openers_aside(page: Column) -> Column:
    """A long page whose openers behind the last end of their kind are marked, so that no search for an end starts there."""
    def marking(opener, ending):
        return lambda p: _with(F.regexp_extract(p, rf"(?is)^(.*{ending})", 1), lambda closed: F.concat(
            closed, F.regexp_replace(F.substr(p, F.length(closed) + 1), f"(?i){opener}", _ASIDE + "$1")))
    page = _with(page, marking(r"<(!--)", "-->"))
    for tag in ("script", "style", "head", "nav"):
        page = _with(page, marking(rf"<({tag}\b)", rf"</{tag}\s*>"))
    return page


def _untagged(text: Column) -> Column:
    """Tags dropped, those of blocks for line ends; what follows the last ``>`` is not searched for tags."""
    return _with(text, lambda t: _with(F.substring_index(t, ">", -1), lambda rest: F.concat(
        F.regexp_replace(F.regexp_replace(F.left(t, F.length(t) - F.length(rest)), BREAKS, "\n"), TAGS, ""), rest)))


def plain_text(page: Column) -> Column:
    """Text of a page: markup, scripts, styles, navigation dropped; one line per block, single blanks."""
    blanks = lambda t: F.regexp_replace(t, r"[\t\r\n ]+", " ")
    short = F.regexp_replace(F.regexp_replace(blanks(F.regexp_replace(page, DROPPED, "")), BREAKS, "\n"), TAGS, "")
    # the same text, found without searching from openers and tags that nothing ends
    long = _untagged(blanks(F.replace(F.regexp_replace(_openers_aside(page), DROPPED, ""), F.lit(_ASIDE), F.lit("<"))))
    text = _unescaped(F.when(F.octet_length(page) >= LONG, long).otherwise(short))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" *\n[ \n]*", "\n"), r"^\n+|\n+$", ""))


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data.cast("binary"), 256))


def urn(seed: Column) -> Column:
    """A name-based identifier: the same seed, the same identifier."""
    h = F.md5(seed.cast("binary"))
    dashed = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *dashed), F.lit(">"))


def _header_block(block: Column) -> Column:
    return F.substring_index(block, NEWLINE * 2, 1)


def parsed(responses: DataFrame) -> DataFrame:
    """Responses with http_head, body, payload digest; a block without an empty line is all headers."""
    block = F.coalesce(F.col("block").cast("string"), F.lit(""))
    at = F.instr(block, NEWLINE * 2)
    body = F.when(at > 0, F.substr(block, at + 4)).otherwise(F.lit(""))
    return responses.select(
        "record_id", "target_uri", "date", block.alias("block"), _header_block(block).alias("http_head"), body.alias("body"))


def _first(text, pattern):
    return F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"[\t\r\n ]+", " "))


def derivatives(responses: DataFrame) -> DataFrame:
    """One row per record: two for each response, with the record's headers as columns and its block.

    Columns: record_id, type, refers_to, target_uri, date, source_headers, content_type, content_length,
    block_digest, payload_digest (of the source's body), source_digest (of the source's block), block.  A null block
    counts as empty and gives an empty conversion; a null identifier is derived from the URI and the block; null URI
    and date stay null.  Repeated responses give repeated records; an empty table gives none; other columns are
    ignored.
    """
    rows = parsed(responses)
    own = F.coalesce(F.col("record_id").cast("string"), urn(F.concat_ws("\n", "target_uri", "block")))
    head = F.col("http_head")
    fields = [
        ("software", F.lit(SOFTWARE)), ("http-status", F.regexp_extract(head, r"^HTTP/[0-9.]+ ([0-9]+)", 1)),
        ("http-content-type", _first(head, r"(?i)\ncontent-type:([^\r\n]*)")),
        ("title", _unescaped(_first(F.col("body"), r"(?is)<title[^>]*>([^<]*)"))),
        ("language", F.regexp_extract("body", r"""(?i)<html[^>]*\blang=["']?([A-Za-z-]+)""", 1)),
        ("outlinks", F.size(F.regexp_extract_all("body", F.lit(r"(?i)(<a\s[^>]*href)"), F.lit(1))).cast("string")),
    ]
    lines = [F.when(value != "", F.concat(F.lit(name + ": "), value, F.lit(NEWLINE))).otherwise("") for name, value in fields]
    head_end = F.instr(head, NEWLINE)
    source = F.when(head_end > 0, F.substr(head, head_end + 2)).otherwise(F.lit(""))
    rows = rows.select(
        own.alias("refers_to"), F.col("target_uri").cast("string").alias("target_uri"), F.col("date").cast("string").alias("date"),
        source.alias("source_headers"), digest(F.col("body")).alias("payload_digest"),
        digest(F.col("block")).alias("source_digest"), F.concat(*lines).alias("metadata"), plain_text(F.col("body")).alias("text"))
    kinds = F.array(F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), F.col("metadata").alias("block")),
                    F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")))
    rows = rows.withColumn("record", F.explode(kinds)).select("*", "record.*")
    return rows.select(
        urn(F.concat_ws("\n", "type", "refers_to")).alias("record_id"), "type", "refers_to", "target_uri", "date", "source_headers",
        "content_type", F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"),
        "payload_digest", "source_digest", "block")


def serialised(records: DataFrame) -> DataFrame:
    """record_id, record: each record as it stands in an archive file (UTF-8 text)."""
    def line(name, column):
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(name + ": "), F.col(column).cast("string"), F.lit(NEWLINE))).otherwise("")
    named = (("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "payload_digest"),
             ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    text = F.concat(F.lit("WARC/1.1" + NEWLINE), *[line(*n) for n in named], F.lit(NEWLINE), F.col("block"), F.lit(NEWLINE * 2))
    return records.select("record_id", text.alias("record"))


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (page_id, url, html): the block is an HTTP answer around the page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\nX-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return pages.select(
        urn(F.concat_ws("\n", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), html)).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit("1970-01-01T00:00:00Z").alias("date"), F.concat(head, F.lit(NEWLINE * 2), html).alias("block"))
