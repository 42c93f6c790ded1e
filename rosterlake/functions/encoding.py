"""Encoding repair for binary columns.

Valid UTF-8 never leaves the JVM; only the failing rows go through Python,
because SQL ``decode`` accepts neither Big5 nor GBK.
"""

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType, StructType

_BAD_RUN = re.compile("[\udc80-\udcff]+")


def _round_trips(raw: bytes, codec: str):
    """Decoded text and whether encoding it again gives the same bytes."""
    try:
        text = raw.decode(codec)
    except UnicodeDecodeError:
        return None, False
    try:
        return text, text.encode(codec) == raw
    except UnicodeEncodeError:
        return text, False


def _replace_runs(raw: bytes) -> str:
    """UTF-8 with every run of invalid bytes shown as one replacement mark."""
    return _BAD_RUN.sub("\ufffd", raw.decode("utf-8", "surrogateescape"))


@F.pandas_udf(StructType().add("verdict", StringType()).add("text", StringType()))
def _repair(raws: pd.Series) -> pd.DataFrame:
    def one(raw):
        if raw is None:
            return (None, None)
        raw = bytes(raw)
        big5, big5_exact = _round_trips(raw, "big5")
        gbk, gbk_exact = _round_trips(raw, "gbk")
        if big5_exact:
            return ("big5", big5)
        if big5 is not None:
            return ("gbk", gbk) if gbk_exact else ("big5_lossy", big5)
        if gbk is not None:
            return ("gbk", gbk)
        return ("replaced", _replace_runs(raw))
    return pd.DataFrame([one(r) for r in raws], columns=["verdict", "text"], dtype=object)


@F.pandas_udf(StringType())
def _first_decoder(raws: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        for codec in ("big5", "gbk"):
            text, _ = _round_trips(bytes(raw), codec)
            if text is not None:
                return text
        return _replace_runs(bytes(raw))
    return raws.map(one)


def _is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def _broken_only(raw: Column) -> Column:
    """NULL for valid rows, so their bytes are not sent to Python."""
    return F.when(~_is_utf8(raw), raw)


def repair_frame(df, raw: str, text="text", verdict="verdict"):
    """Adds repaired ``text`` and a ``verdict`` saying which step decided."""
    fixed = df.withColumn("_fix", _repair(_broken_only(F.col(raw))))
    return (fixed
            .withColumn(verdict, F.when(F.col(raw).isNotNull(),
                                        F.coalesce(F.col("_fix.verdict"), F.lit("utf8"))))
            .withColumn(text, F.coalesce(F.col("_fix.text"), F.col(raw).cast("string")))
            .drop("_fix"))


def repair_simple(raw: Column) -> Column:
    """Variant without the round-trip check: first decoder that accepts."""
    return F.coalesce(_first_decoder(_broken_only(raw)), raw.cast("string"))


def decode_base64(content: Column) -> Column:
    """Decoded bytes; content that is not base64 is kept as it is."""
    trimmed = F.regexp_replace(content, r"[\r\n]", "")
    return F.coalesce(F.try_to_binary(F.trim(trimmed), F.lit("base64")),
                      F.encode(content, "UTF-8"))
