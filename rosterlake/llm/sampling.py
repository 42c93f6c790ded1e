"""Bounded samples of rows for training: chosen by a hash of the id, so every row has the same chance."""

from pyspark.sql import Column, DataFrame, functions as F

PARTS = 1 << 20


def part(*columns) -> Column:
    """A row's fixed place among ``PARTS`` equal parts of all rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS))


def thinned(df: DataFrame, key: Column, rows: int, total: int, salt=17) -> DataFrame:
    """About ``rows`` of ``total`` rows; all of them if there are no more.  Another ``salt`` gives an independent choice."""
    return df if total <= rows else df.filter(part(key, F.lit(salt)) < F.lit(int(PARTS * rows / total) + 1))


def thinned_by(df: DataFrame, by: Column, key: Column, rows: int, totals: dict, salt=17) -> DataFrame:
    """About ``rows`` rows of every value of ``by``, in one pass; ``totals`` has the number of rows of each."""
    keep = F.lit(False)
    for value, total in totals.items():
        keep = F.when(by == value, part(key, F.lit(salt)) < F.lit(int(PARTS * rows / total) + 1)).otherwise(keep)
    return df.filter(keep)


def window_of(text: Column, key: Column, chars: int) -> Column:
    """A stretch of ``chars`` characters at a place that the row's hash chooses."""
    room = F.greatest(F.char_length(text) - chars, F.lit(0)) + 1
    return F.substring(text, F.pmod(F.xxhash64(key, F.lit(5)), room).cast("int") + 1, F.lit(chars))
