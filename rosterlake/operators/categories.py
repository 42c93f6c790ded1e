"""Category folding and category sections."""

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import vocab
from .classify import first_true


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _via(table: dict, key: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(table), key), key)


def fold_a(category: Column) -> Column:
    """Alias, then parent, then the vocabulary itself, else 'other'."""
    c = _via(vocab.CATEGORY_ALIASES_A, F.lower(F.trim(category)))
    return F.coalesce(F.try_element_at(_map(vocab.CATEGORY_PARENT), c),
                      F.when(c.isin(*vocab.VALID_CATEGORIES), c), F.lit("other"))


def fold_b(category: Column) -> Column:
    """Spelling variants first (blanks and underscores become one hyphen), the
    alias table before and after, then functional keys only."""
    raw = _via(vocab.CATEGORY_ALIASES_B, F.lower(F.trim(category)))
    dashed = F.trim(F.regexp_replace(raw, "[ _-]+", "-"), F.lit("-"))
    c = _via(vocab.CATEGORY_ALIASES_B, dashed)
    return F.coalesce(F.try_element_at(_map(vocab.CATEGORY_PARENT), c),
                      F.when(c.isin(*vocab.FUNCTIONAL_CATEGORIES), c), F.lit("other"))


def fold_list_b(categories: Column) -> Column:
    """Distinct folded keys; 'other' only when nothing functional is left."""
    folded = F.array_distinct(F.transform(categories, fold_b))
    functional = F.array_except(folded, F.array(F.lit("other")))
    return F.when(F.size(functional) > 0, functional).otherwise(folded)


def in_section(categories: Column, level: Column, key: str) -> Column:
    """Row belongs to a category section; T0 rows belong to none."""
    folded = fold_list_b(categories)
    if key == "other":
        inside = F.size(F.array_except(folded, F.array(F.lit("other")))) == 0
    else:
        inside = F.array_contains(folded, key.strip().lower())
    return (level != "T0") & inside


def first_section(categories: Column) -> Column:
    """First functional section in catalogue order: each row appears once."""
    folded = fold_list_b(categories)
    ordered = [k for k in vocab.FUNCTIONAL_CATEGORIES if k != "other"]
    return first_true([(F.array_contains(folded, k), F.lit(k)) for k in ordered], "other")


def counts(df: DataFrame, categories="categories") -> DataFrame:
    """Rows per folded category; rows without any count as 'uncategorized'."""
    folded = F.when(F.size(categories) > 0, fold_list_b(F.col(categories))) \
              .otherwise(F.array(F.lit("uncategorized")))
    return (df.select(F.explode(folded).alias("category"))
            .groupBy("category").agg(F.count("*").alias("entities")))


def source_counts(df: DataFrame, sources="sources", default="github") -> DataFrame:
    """Rows per source name; rows without a source count for the default only
    when no row has one."""
    names = F.when(F.size(sources) > 0, F.transform(sources, lambda s: s["source"])) \
             .otherwise(F.array(F.lit(None).cast("string")))
    counted = df.select(F.explode(names).alias("source")).groupBy("source").agg(F.count("*").alias("entities"))
    # one row per source name from here on
    totals = counted.agg(F.count("source").alias("named"), F.sum("entities").alias("all"))
    fallback = totals.filter(F.col("named") == 0).select(F.lit(default).alias("source"), F.col("all").alias("entities"))
    return counted.filter(F.col("source").isNotNull()).unionByName(fallback)
