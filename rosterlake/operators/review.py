"""Merging external review answers into rule results.

Answers are a landed table ``(key, model_order, answer)`` with JSON text.  They
may change class, role, confidence and evidence, never a factual column.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands
from ..rules import vocab
from . import evidence as E

ANSWER = "struct<classification:string,confidence:double,evidence:array<string>,mcp_role:string,reason:string>"
REGION_ANSWER = "struct<taiwan_relevance:string,score:double,confidence:double>"


def parse(answers: DataFrame, schema=ANSWER) -> DataFrame:
    return answers.withColumn("a", F.from_json("answer", schema, {"mode": "PERMISSIVE"}))


def valid_answer(a: Column) -> Column:
    role = F.coalesce(a["mcp_role"], F.lit(""))
    return F.coalesce(
        (a["confidence"] > 0) & a["classification"].isin(*vocab.PRIMARY_CLASSES)
        & ((role == "") | role.isin(*vocab.ROLES)), F.lit(False))


def first_valid(answers: DataFrame, key: str, schema=ANSWER, valid=valid_answer) -> DataFrame:
    """First valid answer per key in model order; one row per key map-side."""
    ok = parse(answers, schema).withColumn("ok", valid(F.col("a")))
    chosen = F.min_by(F.struct("a", "model_order"),
                      F.when(F.col("ok"), F.col("model_order")))
    return ok.groupBy(key).agg(chosen.alias("c"), F.count("*").alias("answers")) \
             .select(key, "answers", F.col("c.a").alias("answer"), F.col("c.model_order").alias("model_order"))


def merge(rows: DataFrame, answers: DataFrame, key="id", result="classification",
          routed: Column = None) -> DataFrame:
    """Replaces ``result`` of routed rows by their first valid answer; routed
    rows without one keep the rule result plus a failure evidence item."""
    best = first_valid(answers, key)
    r, a = F.col(result), F.col("answer")
    routed = F.lit(True) if routed is None else routed
    take = routed & a.isNotNull()
    answer_items = F.transform(
        F.coalesce(a["evidence"], F.array().cast("array<string>")),
        lambda m: F.struct(
            F.lit("llm_classification").alias("type"), F.concat(F.lit("llm:"), F.col("model_order")).alias("source"),
            F.lit("llm_fallback").alias("rule"), m.alias("matched"),
            (a["confidence"] * 100).alias("score"), a["confidence"].alias("confidence")))
    failure = E.item("llm_fallback_failure", "llm_classifier", "fallback_error", "no valid answer", 0.0)
    merged = F.struct(
        F.when(take, a["classification"]).otherwise(r["primary"]).alias("primary"),
        F.when(take & (F.coalesce(a["mcp_role"], F.lit("")) != ""), a["mcp_role"]).otherwise(r["role"]).alias("role"),
        F.when(take, F.lit("review")).otherwise(r["rule"]).alias("rule"),
        F.when(take, a["confidence"]).otherwise(r["confidence"]).alias("confidence"),
        F.when(take, F.concat(r["evidence"], answer_items))
         .when(routed, F.concat(r["evidence"], F.array(failure)))
         .otherwise(r["evidence"]).alias("evidence"))
    return (rows.join(best, key, "left").withColumn(result, merged)
            .drop("answer", "answers", "model_order"))


def valid_region_answer(a: Column) -> Column:
    return F.coalesce((a["confidence"] > 0) & a["taiwan_relevance"].isin(*vocab.REGION_LEVELS), F.lit(False))


def merge_region(rows: DataFrame, answers: DataFrame, key="id") -> DataFrame:
    """Older form over region levels: routed rows without a valid answer fall
    back to T2, score 35, confidence 0.5."""
    best = first_valid(answers, key, REGION_ANSWER, valid_region_answer)
    a = F.col("answer")
    routed = F.col("region_score").between(20, 55)
    joined = rows.join(best, key, "left")
    return (joined
            .withColumn("region_confidence", F.when(routed, F.coalesce(a["confidence"], F.lit(0.5))).otherwise(1.0))
            .withColumn("region_level", F.when(routed, F.coalesce(a["taiwan_relevance"], F.lit("T2")))
                        .otherwise(bands.region_level(F.col("region_score"))))
            .withColumn("region_score", F.when(routed, F.coalesce(a["score"], F.lit(35.0)))
                        .otherwise(F.col("region_score")))
            .drop("answer", "answers", "model_order"))
