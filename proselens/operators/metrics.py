"""Per-row text measures: attribute text, combined features, length, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.config import EvalConfig
from proselens.functions.scoring import gate_failure, normalize_coverage, overall_score, rejection_labels
from proselens.functions.text import col_, nonblank_lines, py_strip


def attribute_text(features="features", technical_data="technical_data", ibf="ibf_data") -> "F.Column":
    """``"IBF: x. Features: a, b. Technical Data: k: v, ... ."``.

    Empty sections are left out: blank features, map entries with an empty
    value and an empty enrichment text do not print.
    """
    ibf_c = col_(ibf)
    feats = F.filter(col_(features), lambda f: f.isNotNull() & (py_strip(f) != ""))
    entries = F.filter(F.map_entries(col_(technical_data)), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    tech = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return F.concat_ws(
        " ",
        F.when(ibf_c.isNotNull() & (ibf_c != ""), F.concat(F.lit("IBF: "), ibf_c, F.lit("."))),
        F.when(F.size(feats) > 0, F.concat(F.lit("Features: "), F.array_join(feats, ", "), F.lit("."))),
        F.when(tech != "", F.concat(F.lit("Technical Data: "), tech, F.lit("."))),
    )


def combined_features(features="features", technical_data="technical_data", ibf="ibf_data",
                      include_enrichment: bool = True) -> "F.Column":
    """Stripped non-empty features + spec keys + non-empty enrichment lines."""
    f = F.filter(F.transform(F.coalesce(col_(features), F.array().cast("array<string>")), py_strip),
                 lambda x: x.isNotNull() & (x != ""))
    k = F.filter(F.transform(F.map_keys(F.coalesce(col_(technical_data), F.create_map().cast("map<string,string>"))),
                             py_strip), lambda x: x != "")
    parts = [f, k]
    if include_enrichment:
        parts.append(nonblank_lines(ibf))
    return F.concat(*parts)


def length_measures(df: DataFrame, cfg: EvalConfig = EvalConfig(), text_col: str = "marketing_text") -> DataFrame:
    """``char_len`` (code points) and ``in_range``."""
    return (df.withColumn("char_len", F.length(F.coalesce(F.col(text_col), F.lit(""))))
            .withColumn("in_range", F.col("char_len").between(cfg.min_chars, cfg.max_chars)))


def add_scores(df: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """X9-X11 on result rows: overall score, gate result, rejection labels.

    Labels are only computed for rows that fail a gate (blank otherwise).
    """
    # the gates read overall_score, so it is defined in its own step
    out = df.withColumn("overall_score", overall_score()).withColumn("_gate", gate_failure())
    passed = F.col("_gate").isNull()
    out = out.withColumns({
        "passed_quality_gates": passed,
        "gate_failure_reason": F.coalesce("_gate", F.lit("")),
        "rejection_reasons": F.when(passed, F.lit("")).otherwise(F.array_join(rejection_labels(cfg), ", ")),
    })
    return out.drop("_gate")


def add_normalized_coverage(df: DataFrame, cov: str = "semantic_feature_coverage",
                            n: str = "num_features") -> DataFrame:
    """X8 as a column ``semantic_feature_coverage_normalized``."""
    return df.withColumn("semantic_feature_coverage_normalized", normalize_coverage(cov, n))
