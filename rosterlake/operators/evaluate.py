"""Classifier evaluation against labels."""

from pyspark.sql import Column, DataFrame, functions as F

EXCELLENT_BELOW, PASS_BELOW = 0.02, 0.05


def outcome(expected: Column, predicted: Column) -> Column:
    return (F.when(expected & predicted, "TP").when(expected, "FN").when(predicted, "FP").otherwise("TN"))


def joined(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Labels with their prediction; labels without one keep ``matched=false``."""
    p = predictions.select(key, F.col("predicted").cast("boolean").alias("predicted"))
    return labels.join(p, key, "left").withColumn("matched", F.col("predicted").isNotNull())


def metrics(pairs: DataFrame, expected="expected", predicted="predicted", by=()) -> DataFrame:
    """Confusion counts and ratios in one aggregate.

    ``fdr`` is FP/(TP+FP); it is also given under the name ``fpr_reported``,
    which reports use for it, next to the true false-positive rate.  Nothing
    matched gives a NULL status, not a pass.
    """
    e, p = F.col(expected).cast("boolean"), F.col(predicted).cast("boolean")
    known = p.isNotNull()
    base = pairs.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(known).alias("matched"),
        F.count_if(known & e & p).alias("tp"), F.count_if(known & ~e & p).alias("fp"),
        F.count_if(known & ~e & ~p).alias("tn"), F.count_if(known & e & ~p).alias("fn"))
    c = F.col
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return (base
            .withColumn("precision", div(c("tp"), c("tp") + c("fp")))
            .withColumn("recall", div(c("tp"), c("tp") + c("fn")))
            .withColumn("f1", div(c("precision") * c("recall") * 2, c("precision") + c("recall")))
            .withColumn("fdr", div(c("fp"), c("tp") + c("fp")))
            .withColumn("fpr_reported", c("fdr"))
            .withColumn("fpr", div(c("fp"), c("fp") + c("tn")))
            .withColumn("status", F.when(c("matched") == 0, F.lit(None).cast("string"))
                        .when(c("fdr") < EXCELLENT_BELOW, "EXCELLENT")
                        .when(c("fdr") < PASS_BELOW, "PASS").otherwise("FAIL")))


def misclassified(pairs: DataFrame, key: str, expected="expected", predicted="predicted") -> DataFrame:
    return (pairs.withColumn("outcome", outcome(F.col(expected), F.col(predicted)))
            .filter(F.col(predicted).isNotNull() & F.col("outcome").isin("FP", "FN")))
