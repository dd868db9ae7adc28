"""Scoring rules: composite score, quality gates, rejection labels.

All rules are ``F.when`` chains over double columns.  Reads go through
``safe_double`` (NULL or unparsable -> default), the defaults differ per rule
on purpose: a missing hallucination score counts 10 in the composite score,
0 in the gate and 10 in the labels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselens.config import EvalConfig
from proselens.functions.text import col_, contains_any, fixed

_CFG = EvalConfig()


def safe_double(c, default: float) -> Column:
    """NULL, NaN or unparsable -> default (``try_cast``; ANSI mode stays on)."""
    return F.coalesce(F.nanvl(col_(c).try_cast("double"), F.lit(None).cast("double")), F.lit(float(default)))


def safe_bool(c, default: bool) -> Column:
    return F.coalesce(col_(c).try_cast("boolean"), F.lit(default))


def normalize_coverage(cov, n) -> Column:
    """Piecewise map from covered share and feature count to [0, 1]."""
    n_ = col_(n).cast("double")
    m = col_(cov).cast("double") * n_
    return (F.when(n_ == 0, F.lit(0.0))
            .when(m < 2, 0.75 * (m / 2))
            .when(m < 3, 0.75 + (m - 2) * 0.15)
            .when(m < 4, 0.90 + (m - 3) * 0.05)
            .otherwise(F.least(F.lit(1.0), 0.95 + (m - 4) * 0.0125)))


def overall_score(hallucination="hallucination_score", alignment="semantic_attribute_alignment",
                  judge="judge_score", coverage_norm="semantic_feature_coverage_normalized") -> Column:
    """Composite score 0..10 with two hard floors."""
    hall = safe_double(hallucination, 10.0)
    align = safe_double(alignment, 0.0)
    judge_ = safe_double(judge, 0.0)
    cov = safe_double(coverage_norm, 0.0)
    weighted = (0.5 * (judge_ / 10.0) + 0.25 * align + 0.1 * cov + 0.15 * (hall / 10.0)) * 10.0
    return F.when(hall < 7.0, F.lit(3.0)).when(align < 0.25, F.lit(4.0)).otherwise(weighted)


# Gate order, thresholds and messages.
_GATES = [
    ("judge_score", "judge_score", 0.0, 7.0, "7.0", "Judge score too low"),
    ("relevance_score", "relevance", 0.0, 3.5, "3.5", "Relevance too low"),
    ("generalization_score", "generalization", 0.0, 3.0, "3.0", "Generalization too low"),
    ("hallucination_score", "hallucination", 0.0, 8.0, "8.0", "Hallucination detected"),
    ("semantic_attribute_alignment", "attribute_alignment", 0.0, 0.35, "0.35", "Poor attribute alignment"),
]


def gate_failure(overall="overall_score", in_range="in_range") -> Column:
    """Message of the first failing gate, NULL when every gate passes."""
    out = None
    for col_name, label, default, limit, limit_txt, msg in _GATES:
        v = safe_double(col_name, default)
        m = F.concat(F.lit(f"{msg} ({label}: "), fixed(v, 2), F.lit(f" < {limit_txt})"))
        out = F.when(v < limit, m) if out is None else out.when(v < limit, m)
    rng = safe_bool(in_range, False)
    out = out.when(~rng, F.lit("Length out of range (in_range: False)"))
    ov = safe_double(overall, 0.0)
    out = out.when(~(ov >= 7.0), F.concat(F.lit("Overall score below threshold ("), fixed(ov, 2), F.lit(" < 7.0)")))
    return out


# Keyword lists of the rejection taxonomy.
SPECIFIC_WORDS = ["specific", "narrow", "limited"]
GENERIC_WORDS = ["generic", "vague", "non-specific"]
UNCLEAR_WORDS = ["unclear", "confusing", "hard to understand"]
CLAIM_WORDS = ["claim", "unsupported", "unverified"]
BIAS_WORDS = ["bias", "stereotyp"]


def rejection_labels(cfg: EvalConfig = _CFG, reason="judge_reason", char_len="char_len") -> Column:
    """ARRAY<STRING> of rejection categories, in taxonomy order.

    Defaults are the passing values (relevance 5, generalization 5,
    hallucination 10, in range, coverage 1.0, alignment 1.0); an empty result
    becomes ``['low_overall_quality']``.
    """
    rel = safe_double("relevance_score", 5.0)
    gen = safe_double("generalization_score", 5.0)
    hall = safe_double("hallucination_score", 10.0)
    rng = safe_bool("in_range", True)
    cov = safe_double("semantic_feature_coverage_normalized", 1.0)
    align = safe_double("semantic_attribute_alignment", 1.0)
    r = col_(reason)
    labels = F.array(
        F.when(hall < 8, F.lit("hallucination")).when(rel < 3.5, F.lit("not_relevant")),
        F.when(gen < 3.0, F.when(contains_any(r, SPECIFIC_WORDS), F.lit("too_specific"))
               .when(contains_any(r, GENERIC_WORDS), F.lit("too_generic"))
               .otherwise(F.lit("poor_generalization"))),
        F.when(~rng, F.when(col_(char_len) < cfg.too_short_limit, F.lit("too_short")).otherwise(F.lit("too_long"))),
        F.when(contains_any(r, UNCLEAR_WORDS), F.lit("unclear")),
        F.when(contains_any(r, CLAIM_WORDS), F.lit("overclaim")),
        F.when(contains_any(r, BIAS_WORDS), F.lit("bias")),
        F.when(cov < 0.3, F.lit("missing_features")),
        F.when(align < 0.35, F.lit("off_topic")),
    )
    found = F.filter(labels, lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("low_overall_quality"))).otherwise(found)
