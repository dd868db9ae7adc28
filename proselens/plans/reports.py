"""H5-H7: report sets over result tables.

Each function returns named DataFrames; nothing is collected.  Sinks write
them (``proselens.sinks``), or ``long_form`` gives a whole set as one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselens.config import EvalConfig
from proselens.operators import report as RP
from proselens.operators.dedup import duplicate_flags


def optimisation_report(results: DataFrame, cfg: EvalConfig = EvalConfig()) -> dict[str, DataFrame]:
    """H5: per prompt family and iteration - means, best example, issues,
    rejection focus with recommendation, and the top issues per iteration."""
    means = RP.prompt_means(results)
    return {
        "prompt_means": means,
        "improvement_history": RP.improvement_history(means, cfg),
        "rejection_focus": RP.rejection_focus(results, cfg.optimize_threshold, 3),
        "top_issues": RP.top_issues(results, cfg.optimize_threshold, 3, cfg),
    }


def final_report(results: DataFrame, cfg: EvalConfig = EvalConfig(), key: str = "candidate_ord",
                 text: str = "marketing_text") -> dict[str, DataFrame]:
    """H6: duplicates per iteration, rejection analysis, summary, progress
    and the aggregate table."""
    dup = duplicate_flags(results, key=key, text=text, partition=["iteration"],
                          threshold=cfg.dedup_threshold_final, cfg=cfg)
    full = results.drop("is_unique", "duplicate_of").join(
        dup.select("iteration", key, "is_unique", "duplicate_of"), ["iteration", key], "left")
    return {
        "results": full,
        "duplicate_rate": RP.duplicate_rate(dup),
        "rejection_patterns": RP.rejection_patterns(full, cfg.report_threshold),
        "rejection_totals": RP.rejection_totals(full, cfg.report_threshold),
        "worst_example": RP.worst_example(full, cfg.report_threshold, key),
        "quality_summary": RP.quality_summary(full, cfg.report_threshold),
        "iteration_progress": RP.iteration_progress(full, cfg.pass_level),
        "aggregate": RP.aggregate_by_run(full),
    }


def figure_tables(runs: DataFrame, cfg: EvalConfig = EvalConfig()) -> dict[str, DataFrame]:
    """H7: the tables behind the figures, for result tables tagged by
    ``dataset`` (U3)."""
    return {
        "failure_rates": RP.failure_rates(runs, ["dataset", "model"], cfg),
        "score_box": RP.box_stats(runs, ["overall_score", "sbert"], ["dataset", "iteration", "model"], cfg),
        "length_histogram": RP.length_histogram(runs, 20, ["dataset", "iteration", "model"]),
        "score_curve": RP.mean_by(runs, ["dataset", "model", "iteration"], "overall_score", "mean_overall_score"),
        "coverage_trend": RP.mean_by(runs, ["dataset", "model", "iteration"], "semantic_feature_coverage_normalized",
                                     "mean_coverage_normalized"),
    }


def union_iterations(frames: list[DataFrame]) -> DataFrame | None:
    """Result tables of several iterations as one table (columns missing
    in some iterations become NULL); ``None`` when there is nothing."""
    out = None
    for f in frames:
        if f is None:
            continue
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


# What identifies a row of each report table.
KEYS = {
    "prompt_means": ["iteration", "prompt_family"], "improvement_history": ["iteration", "prompt_family"],
    "rejection_focus": ["iteration", "prompt_family"], "top_issues": ["iteration", "rank"],
    "results": ["iteration", "candidate_ord"], "duplicate_rate": ["iteration"], "rejection_patterns": ["reason"],
    "rejection_totals": [], "worst_example": ["candidate_ord"], "quality_summary": [], "iteration_progress": ["iteration"],
    "aggregate": ["iteration", "model", "prompt_name"], "failure_rates": ["dataset", "model", "rule"],
    "score_box": ["dataset", "iteration", "model", "metric"], "length_histogram": ["dataset", "iteration", "model", "bin"],
    "score_curve": ["dataset", "model", "iteration"], "coverage_trend": ["dataset", "model", "iteration"],
}


def _cells(df: DataFrame, keys: list[str]) -> list[tuple[str, Column | None, Column | None]]:
    """(metric, number, text) of every column that is no key; a struct gives a
    cell per field, a list or map its entries as text."""
    out = []

    def cell(name: str, c: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                cell(f"{name}_{f.name}", c[f.name], f.dataType)
        elif isinstance(kind, T.MapType):
            entries = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
            out.append((name, None, F.array_join(F.array_sort(entries), ",")))
        elif isinstance(kind, T.ArrayType):
            out.append((name, None, F.array_join(c.cast("array<string>"), " | ")))
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            out.append((name, RP.r6(c.cast("double")), None))
        else:
            out.append((name, None, c.cast("string")))

    for f in df.schema.fields:
        if f.name not in keys:
            cell(f.name, F.col(f"`{f.name}`"), f.dataType)
    return out


def long_form(tables: dict[str, DataFrame]) -> DataFrame:
    """A report set as one table, a row per cell: (table, key, metric, value,
    text).  Every table is read once; ``key`` joins its key columns by ``|``."""
    out = None
    for name, df in tables.items():
        keys = KEYS[name]
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
        cells = [F.struct(F.lit(m).alias("metric"), (F.lit(None).cast("double") if v is None else v).alias("value"),
                          (F.lit(None).cast("string") if t is None else t).alias("text"))
                 for m, v, t in _cells(df, keys)]
        part = df.select(F.lit(name).alias("table"), key.alias("key"), F.explode(F.array(*cells)).alias("c")) \
            .select("table", "key", "c.metric", "c.value", "c.text")
        out = part if out is None else out.unionByName(part)
    return out
