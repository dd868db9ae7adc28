"""Model replies as a table: parse, default, validate.

Hosted model calls are outside the engine; their raw replies arrive as a
table ``(candidate key..., kind, raw)`` and are turned into typed columns
here, with the defaults of the evaluated pipeline for missing replies and
unparsable text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.functions.jsonx import get_bool, get_double, get_string, has_key, parse_json_tolerant

CLAIMS_TYPE = "array<struct<claim:string,issue:string,severity:string>>"
GENERATION_KEYS = ["header", "subheader", "marketing_text"]


def parse_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """X1 over a reply table: adds ``parsed`` (VARIANT) and ``status``.

    status: ``no_reply`` (NULL or empty), ``parse_error`` (no object, or an
    empty object, which a truthiness test rejects), ``ok``.
    """
    r = replies.withColumn("parsed", parse_json_tolerant(raw))
    empty_obj = F.schema_of_variant("parsed") == "OBJECT<>"
    status = (F.when(F.col(raw).isNull() | (F.col(raw) == ""), F.lit("no_reply"))
              .when(F.col("parsed").isNull() | empty_obj, F.lit("parse_error"))
              .otherwise(F.lit("ok")))
    return r.withColumn("status", status)


def generation_fields(parsed: DataFrame) -> DataFrame:
    """M2/F1: ``valid`` = parsed and all three keys present (JSON null counts)."""
    valid = F.col("status") == "ok"
    for k in GENERATION_KEYS:
        valid = valid & has_key("parsed", k)
    return parsed.select(
        *[c for c in parsed.columns if c not in ("parsed",)],
        valid.alias("valid"),
        *[F.when(valid, get_string("parsed", k)).alias(k) for k in GENERATION_KEYS],
    )


def valid_generations(parsed: DataFrame) -> DataFrame:
    return generation_fields(parsed).filter("valid")


def judge_fields(parsed: DataFrame) -> DataFrame:
    """M3: four fields; ``API error`` / ``Parse error`` reasons with NULL scores;
    a missing reason is ''."""
    ok = F.col("status") == "ok"
    reason = (F.when(F.col("status") == "no_reply", F.lit("API error"))
              .when(~ok, F.lit("Parse error"))
              .when(has_key("parsed", "reason"), get_string("parsed", "reason"))
              .otherwise(F.lit("")))
    return parsed.select(
        *[c for c in parsed.columns if c != "parsed"],
        F.when(ok, get_double("parsed", "overall_score")).alias("judge_score"),
        F.when(ok, get_double("parsed", "relevance_score")).alias("relevance_score"),
        F.when(ok, get_double("parsed", "generalization_score")).alias("generalization_score"),
        reason.alias("judge_reason"),
    )


def factcheck_fields(parsed: DataFrame) -> DataFrame:
    """M4: defaults on error (no hallucination, score 10.0, no claims); a
    missing score key gives 10.0, a JSON null score stays NULL."""
    ok = F.col("status") == "ok"
    err = F.when(F.col("status") == "no_reply", F.lit("API error")).otherwise(F.lit("Parse error"))
    score = F.when(has_key("parsed", "hallucination_score"), get_double("parsed", "hallucination_score")) \
        .otherwise(F.lit(10.0))
    claims = F.when(has_key("parsed", "hallucinated_claims"),
                    F.try_variant_get("parsed", "$.hallucinated_claims", CLAIMS_TYPE)) \
        .otherwise(F.array().cast(CLAIMS_TYPE))
    expl = F.when(has_key("parsed", "explanation"), get_string("parsed", "explanation")).otherwise(F.lit(""))
    return parsed.select(
        *[c for c in parsed.columns if c != "parsed"],
        F.when(ok, get_bool("parsed", "has_hallucination")).otherwise(F.lit(False)).alias("has_hallucination"),
        F.when(ok, score).otherwise(F.lit(10.0)).alias("hallucination_score"),
        F.when(ok, claims).otherwise(F.array().cast(CLAIMS_TYPE)).alias("hallucinated_claims"),
        F.when(ok, expl).otherwise(err).alias("explanation"),
    )


def success_rate(gen: DataFrame, keys: list[str]) -> DataFrame:
    """A10: valid generations / tasks per key group."""
    return gen.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("tasks"),
        F.count_if("valid").cast("bigint").alias("valid"),
    ).withColumn("success_rate", F.round(F.try_divide(F.col("valid").cast("double"), F.col("tasks")), 6))
