"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, PII, best-fit packing.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return rows with
the columns of ``docs``; the last returns token pieces with their places.  An empty table passes through as such,
repeated rows are one group of copies, null texts go with the language stage, and other columns are carried along.
"""

from pyspark.sql import DataFrame, SparkSession

from rosterlake.llm import decontaminate, jaccard, language, packing, pii
from rosterlake.llm.common import table, vocabulary
from rosterlake.session import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no letters, or no clear majority) go."""
    return language.accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word-shingle similarity of 0.8 or more, the one with the smallest id stays."""
    return jaccard.one_per_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; ``n_chars`` follows."""
    return pii.without_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 2048 tokens and their places in sequences."""
    return packing.packed(docs, vocabulary())


STAGES = [
    ("language ID", known_language),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

# a trained random field and deobfuscation cannot be expressed in SQL; tests/llm/test_pipeline.py has brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
