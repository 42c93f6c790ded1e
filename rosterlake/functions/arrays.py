"""Exploding and fencing computed values."""

from pyspark.sql import Column, DataFrame, functions as F


def explode_rows(df: DataFrame, keep, items: Column, alias="item", position: str = None) -> DataFrame:
    """One row per element of a *computed* array.

    A plain ``explode`` lets the optimizer infer a ``size(items) > 0`` filter
    below it, which evaluates an expensive array twice.  The outer form plus a
    filter on the produced row evaluates it once.
    """
    keys = [keep] if isinstance(keep, str) else list(keep)
    if position is None:
        out = df.select(*keys, F.explode_outer(items).alias(alias))
        return out.filter(F.col(alias).isNotNull())
    out = df.select(*keys, F.posexplode_outer(items).alias(position, alias))
    return out.filter(F.col(position).isNotNull())


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds an expensive column that later filters do not evaluate again.

    A filter on a projected column is pushed below the projection with the
    whole expression copied into it, once per reference.  A one-element
    generator computes the value in place and keeps such filters above it.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name))
