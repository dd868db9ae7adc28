"""Job parameters.

The defaults are the fixed values of the evaluated pipeline: length limits,
gate thresholds, score weights and report thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EvalConfig:
    # Character limits of a generated text.
    min_chars: int = 450
    max_chars: int = 600
    # Fixed value: the "too short" label uses its own constant limit.
    too_short_limit: int = 450
    # Rejection thresholds on overall_score.
    report_threshold: float = 7.0
    optimize_threshold: float = 7.5
    # Fixed value: pass level used by the iteration progress table.
    pass_level: float = 8.0
    # Fixed value: target judge score of the improvement report.
    target_score: float = 8.5
    # Similarity thresholds.
    coverage_threshold: float = 0.10
    dedup_threshold_eval: float = 0.99
    dedup_threshold_final: float = 0.95
    word_overlap: float = 0.95
    # Fixed value: normalised coverage below which "fail_feature" is set.
    feature_fail_level: float = 0.75
    # Duplicate detection: postings of a token are dealt into one salt per this
    # many documents, so a task's share does not grow with the posting list.
    hot_token_df: int = 100_000
