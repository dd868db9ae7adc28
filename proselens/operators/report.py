"""Report tables: aggregates, rejection analysis, summaries, figure tables.

Every table is one ``groupBy`` (partial + final aggregation, one shuffle of
the grouped keys) instead of a filter per (iteration, model) value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselens.config import EvalConfig
from proselens.functions.scoring import rejection_labels
from proselens.functions.text import display_name, excerpt, fixed
from proselens.operators.common import broadcast_if_small, materialize

_CFG = EvalConfig()

# Measures averaged by the aggregate table, in output order.
AGGREGATE_MEASURES = [
    "overall_score", "char_len", "sbert", "judge_score", "relevance_score", "generalization_score",
    "judge_score_secondary", "relevance_score_secondary", "generalization_score_secondary",
    "hallucination_score",
]
AGGREGATE_TAIL = ["semantic_feature_coverage", "semantic_feature_coverage_normalized",
                  "semantic_attribute_alignment"]


def r6(c) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def aggregate_by_run(results: DataFrame, keys: Sequence[str] = ("iteration", "model", "prompt_name")) -> DataFrame:
    """A2: means of the measures per (iteration, model, prompt_name);
    ``hallucination_rate`` is the mean of the boolean flag (NULLs skipped)."""
    aggs = [r6(F.avg(c)).alias(c) for c in AGGREGATE_MEASURES]
    aggs.append(r6(F.avg(F.col("has_hallucination").cast("int"))).alias("hallucination_rate"))
    aggs += [r6(F.avg(c)).alias(c) for c in AGGREGATE_TAIL]
    return results.groupBy(*keys).agg(*aggs)


def with_labels(results: DataFrame, cfg: EvalConfig = _CFG) -> DataFrame:
    return results.withColumn("_labels", rejection_labels(cfg))


def rejection_patterns(results: DataFrame, threshold: float = 7.0, keys: Sequence[str] = (),
                       cfg: EvalConfig = _CFG) -> DataFrame:
    """A3: count of each rejection label over rows with ``overall_score <
    threshold``, with the share of rejected rows (not of labels)."""
    rej = with_labels(results.filter(F.col("overall_score") < threshold), cfg)
    counts = rej.select(*keys, F.explode("_labels").alias("reason")).groupBy(*keys, "reason") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    totals = rej.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("rejected"))
    # without keys ``totals`` is a single-row aggregate
    out = counts.join(totals, list(keys)) if keys else counts.join(F.broadcast(totals))
    return out.select(*keys, "reason", display_name("reason").alias("reason_display"), "count",
                      r6(F.col("count") * 100.0 / F.col("rejected")).alias("pct_of_rejected"))


def rejection_totals(results: DataFrame, threshold: float = 7.0) -> DataFrame:
    """A4: all, rejected, approved and their percentages."""
    t = results.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                    F.count_if(F.col("overall_score") < threshold).cast("bigint").alias("rejected"))
    return t.select("total", "rejected", (F.col("total") - F.col("rejected")).alias("approved"),
                    r6(F.try_divide(F.col("rejected") * 100.0, F.col("total"))).alias("rejected_pct"),
                    r6(F.try_divide((F.col("total") - F.col("rejected")) * 100.0, F.col("total"))).alias("approved_pct"))


def top_reasons(patterns: DataFrame, k: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """Most common reasons, descending count, ties by reason name."""
    w = Window.partitionBy(*keys).orderBy(F.desc("count"), F.asc("reason")) if keys else \
        Window.orderBy(F.desc("count"), F.asc("reason"))
    out = patterns.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= k) if k is not None else out


def top_issues(results: DataFrame, threshold: float = 7.5, k: int = 3, cfg: EvalConfig = _CFG) -> DataFrame:
    """Per iteration, the top-k labels of rows below ``threshold`` with
    their share of *all* rows of the iteration."""
    p = rejection_patterns(results, threshold, ["iteration"], cfg).select("iteration", "reason", "count")
    allrows = results.groupBy("iteration").agg(F.count(F.lit(1)).alias("_n"))
    t = top_reasons(p, k, ["iteration"]).join(allrows, "iteration")
    return t.select("iteration", F.col("rank").cast("int").alias("rank"), "reason", "count",
                    r6(F.col("count") * 100.0 / F.col("_n")).alias("pct_of_all"))


def worst_example(results: DataFrame, threshold: float = 7.0, order_col: str = "candidate_ord",
                  cfg: EvalConfig = _CFG) -> DataFrame:
    """The rejected row with the lowest overall score (first on ties)."""
    rej = with_labels(results.filter(F.col("overall_score") < threshold), cfg)
    best = rej.agg(F.min_by(F.struct(*[c for c in rej.columns]),
                            F.struct(F.col("overall_score"), F.col(order_col))).alias("w")) \
        .filter(F.col("w").isNotNull()).select("w.*")  # nothing rejected -> no row
    return best.select(order_col, "product_id", r6("overall_score").alias("overall_score"),
                       r6("judge_score").alias("judge_score"), r6("relevance_score").alias("relevance_score"),
                       r6("hallucination_score").alias("hallucination_score"),
                       F.array_join("_labels", ", ").alias("reasons"),
                       excerpt(F.col("judge_reason"), 150).alias("feedback"))


def quality_summary(results: DataFrame, threshold: float = 7.0, cfg: EvalConfig = _CFG) -> DataFrame:
    """Totals, rejected count and rate, top issue and the pattern map."""
    p = rejection_patterns(results, threshold, (), cfg)
    ranked = top_reasons(p, None)
    pat = ranked.agg(
        F.max_by("reason", F.struct(F.col("count"), -F.col("rank"))).alias("top_issue"),
        F.max("count").alias("top_issue_count"),
        F.map_from_entries(F.collect_list(F.struct("reason", "count"))).alias("all_patterns"),
    )
    tot = results.agg(F.count(F.lit(1)).cast("bigint").alias("total_outputs"),
                      F.count_if(F.col("overall_score") < threshold).cast("bigint").alias("rejected_count"))
    # both sides are single-row aggregates; nothing rejected -> no summary
    return tot.join(F.broadcast(pat.filter(F.col("top_issue").isNotNull()))).select(
        "total_outputs", "rejected_count",
        r6(F.try_divide(F.col("rejected_count").cast("double"), F.col("total_outputs"))).alias("rejection_rate"),
        "top_issue", F.col("top_issue_count").cast("bigint").alias("top_issue_count"), "all_patterns")


def iteration_progress(results: DataFrame, pass_level: float = 8.0) -> DataFrame:
    """Mean overall score and pass rate per iteration, ascending."""
    return results.groupBy("iteration").agg(
        r6(F.avg("overall_score")).alias("mean_score"),
        r6(F.avg((F.col("overall_score") >= pass_level).cast("int"))).alias("pass_rate"),
    ).orderBy("iteration")


# Failure rules of the figure tables.
FAILURE_RULES = ["fail_char_range", "fail_feature", "fail_grounding", "fail_prohibited", "fail_unique"]


def failure_flags(results: DataFrame, cfg: EvalConfig = _CFG) -> DataFrame:
    """Boolean failure columns; NULL counts as not failed."""
    return results.withColumns({
        "fail_char_range": F.coalesce(~F.col("in_range"), F.lit(False)),
        "fail_feature": F.coalesce(F.col("semantic_feature_coverage_normalized") < cfg.feature_fail_level, F.lit(False)),
        "fail_grounding": F.coalesce(F.col("has_hallucination") == F.lit(True), F.lit(False)),
        "fail_prohibited": F.lit(False),
        "fail_unique": F.coalesce(F.col("is_unique") == F.lit(False), F.lit(False)),
    })


def failure_rates(results: DataFrame, keys: Sequence[str] = ("model",), cfg: EvalConfig = _CFG) -> DataFrame:
    """Failure rate in percent per rule and key group, as (keys, rule, rate)."""
    f = failure_flags(results, cfg)
    wide = f.groupBy(*keys).agg(*[(F.avg(F.col(r).cast("int")) * 100.0).alias(r) for r in FAILURE_RULES])
    long = wide.unpivot(list(keys), FAILURE_RULES, "rule", "failure_rate_pct")
    return long.withColumn("failure_rate_pct", r6("failure_rate_pct"))


QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def ranked_values(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, value, n, first): how often each value occurs in its group and
    the 0-based rank of its first occurrence, exact at any size.

    Distinct values are counted, range-partitioned by group and value and
    written once; ranks are running counts within a partition plus the counts
    of the group's earlier partitions (one row per group and partition), so
    no task holds more of a group than its range.
    """
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = [*keys, value]
    ranged = materialize(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    within = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*keys, "_part").agg(F.sum("n").alias("_n")) \
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = ranged.withColumn("_local", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return local.join(before, [*keys, "_part"]).select(
        *keys, value, "n", (F.col("_before") + F.col("_local")).alias("first"))


def box_stats(results: DataFrame, metrics: Sequence[str] = ("overall_score", "sbert"),
              keys: Sequence[str] = ("iteration", "model"), cfg: EvalConfig = _CFG) -> DataFrame:
    """Quartiles (linear interpolation), 1.5 IQR whiskers and outliers.

    Exact at any size: see ``ranked_values``.  Whiskers are the extreme values
    inside the fences; the fences are one row per group.
    """
    long = results.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")) \
        .select(*keys, "_m.metric", "_m.value").filter(F.col("value").isNotNull())
    gk = [*keys, "metric"]
    ranked = ranked_values(long, gk)
    sizes = broadcast_if_small(ranked.groupBy(*gk).agg(F.sum("n").cast("bigint").alias("_size")))
    at = ranked.join(sizes, gk)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("value")))

    ends, quantiles = [], []
    for name, p in QUANTILES.items():
        place = (F.col("_size") - 1) * p
        ends += [value_at(F.floor(place)).alias(f"_lo_{name}"), value_at(F.ceil(place)).alias(f"_hi_{name}")]
        share = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        quantiles.append((lo + (hi - lo) * share).alias(name))
    stats = at.groupBy(*gk).agg(F.max("_size").alias("n"), *ends).select(*gk, "n", *quantiles)
    stats = stats.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
                 .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    stats = broadcast_if_small(materialize(stats, "box"))
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    out = ranked.withColumnRenamed("n", "_times").join(stats, gk).groupBy(*gk, "n", *QUANTILES).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("_times"))), F.lit(0)).cast("bigint").alias("n_outliers"))
    return out.select(*gk, "n", *[r6(c).alias(c) for c in (*QUANTILES, "whisker_lo", "whisker_hi")], "n_outliers")


def length_histogram(results: DataFrame, bins: int = 20, keys: Sequence[str] = ("iteration", "model"),
                     value: str = "char_len") -> DataFrame:
    """``bins`` equal-width bins between the group's min and max (last
    bin closed on the right; a constant group is widened by 0.5 each side).
    Every bin is listed, empty ones with count 0."""
    v = F.col(value).cast("bigint")
    rng = results.groupBy(*keys).agg(F.min(value).cast("bigint").alias("_min"),
                                     F.max(value).cast("bigint").alias("_max"))
    j = results.select(*keys, v.alias("_v")).join(broadcast_if_small(rng), list(keys))
    b = F.when(F.col("_max") == F.col("_min"), F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_min")) * bins / (F.col("_max") - F.col("_min"))).cast("int"),
                F.lit(bins - 1)))
    counts = j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    grid = rng.select(*keys, "_min", "_max", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo = F.when(F.col("_max") == F.col("_min"), F.col("_min") - 0.5).otherwise(F.col("_min").cast("double"))
    hi = F.when(F.col("_max") == F.col("_min"), F.col("_max") + 0.5).otherwise(F.col("_max").cast("double"))
    width = (hi - lo) / bins
    out = grid.join(counts, [*keys, "bin"], "left")
    return out.select(*keys, "bin", r6(lo + F.col("bin") * width).alias("bin_lo"),
                      r6(lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def mean_by(results: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of one measure per key group."""
    return results.groupBy(*keys).agg(r6(F.avg(value)).alias(out))


def duplicate_rate(flags: DataFrame, key: str = "iteration") -> DataFrame:
    """``1 - mean(is_unique)`` per iteration."""
    return flags.groupBy(key).agg(r6(1.0 - F.avg(F.col("is_unique").cast("int"))).alias("duplicate_rate"))


def quality_report(df: DataFrame) -> DataFrame:
    """One row with the means of the measures that exist; no rows, no report."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("total_samples")]
    names = {"semantic_similarity_gold": "avg_gold_similarity",
             "semantic_attribute_alignment": "avg_attribute_alignment",
             "semantic_feature_coverage": "avg_feature_coverage"}
    for c, n in names.items():
        if c in df.columns:
            aggs.append(r6(F.avg(c)).alias(n))
    if "is_unique" in df.columns:
        aggs.append(r6(F.avg(F.col("is_unique").cast("int"))).alias("uniqueness_rate"))
        aggs.append(F.count_if(~F.col("is_unique")).cast("bigint").alias("duplicate_count"))
    return df.agg(*aggs).filter("total_samples > 0")


# --- improvement report (per prompt family and iteration) ------------------

_MEANS = {
    "avg_score": "judge_score", "avg_relevance": "relevance_score", "avg_generalization": "generalization_score",
    "avg_length": "char_len", "avg_hallucination_score": "hallucination_score",
    "avg_attribute_alignment": "semantic_attribute_alignment",
    "avg_feature_coverage": "semantic_feature_coverage_normalized", "avg_overall_composite": "overall_score",
}


def prompt_means(results: DataFrame, keys: Sequence[str] = ("iteration", "prompt_family"),
                 order_col: str = "candidate_ord") -> DataFrame:
    """A5 + T1: per prompt family, means with NULLs skipped (0.0 when none),
    mean covered features, sample size and the best example (first of the
    top overall scores)."""
    aggs = [F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for n, c in _MEANS.items()]
    covered = F.col("semantic_feature_coverage") * F.col("num_features")
    aggs.append(F.coalesce(F.avg(covered), F.lit(0.0)).alias("avg_features"))
    aggs.append(F.count(F.lit(1)).cast("bigint").alias("sample_size"))
    aggs.append(F.max_by(F.struct(F.col("product_id"), F.col("overall_score").alias("score"),
                                  F.col("char_len").alias("length"), F.col("model")),
                         F.struct(F.col("overall_score"), -F.col(order_col))).alias("best_example"))
    return results.groupBy(*keys).agg(*aggs)


def issue_list(means: DataFrame, cfg: EvalConfig = _CFG) -> Column:
    """Issue messages of one prompt family, in check order."""
    # The message texts.
    s, ln, f = F.col("avg_score"), F.col("avg_length"), F.col("avg_features")
    h, a, c = F.col("avg_hallucination_score"), F.col("avg_attribute_alignment"), F.col("avg_feature_coverage")
    msgs = F.array(
        F.when(s < cfg.target_score, F.concat(F.lit("Average score "), fixed(s, 1),
                                              F.lit(f" below threshold {cfg.target_score}"))),
        F.when(ln < cfg.min_chars, F.concat(F.lit("Texts too short (avg "), fixed(ln, 0), F.lit(" chars)"))),
        F.when(ln > cfg.max_chars, F.concat(F.lit("Texts too long (avg "), fixed(ln, 0), F.lit(" chars)"))),
        F.when(f < 3, F.concat(F.lit("Not enough features (avg "), fixed(f, 1), F.lit(")"))),
        F.when(h < 8.0, F.concat(F.lit("High hallucination rate ("), fixed(h, 1), F.lit("/10)"))),
        F.when(a < 0.50, F.concat(F.lit("Low attribute alignment ("), fixed(a, 3), F.lit(")"))),
        F.when(c < 0.70, F.concat(F.lit("Low feature coverage ("), fixed(c, 3), F.lit(")"))),
    )
    return F.filter(msgs, lambda x: x.isNotNull())


# The recommendation for each top rejection reason.
RECOMMENDATIONS = {
    "too_generic": "⚠️ CRITICAL: Require specific technical features with measurements",
    "missing_features": "⚠️ CRITICAL: Require 3-5 concrete product features",
    "too_short": "⚠️ CRITICAL: Make 450-600 char requirement MORE prominent",
    "too_long": "⚠️ CRITICAL: Prioritize top 3 features only",
    "not_relevant": "⚠️ CRITICAL: Every claim MUST reference product data",
    "hallucination": "⚠️ CRITICAL: ZERO invented specifications allowed",
    "unclear": "⚠️ CRITICAL: Write for non-technical buyers",
    "overclaim": "⚠️ CRITICAL: Ban superlatives unless in product data",
    "off_topic": "⚠️ CRITICAL: Strengthen connection to product attributes",
}


def recommendation(reason) -> Column:
    """Lookup in a 9-entry literal map; other reasons give NULL."""
    m = F.create_map(*[x for k, v in RECOMMENDATIONS.items() for x in (F.lit(k), F.lit(v))])
    return m[reason if isinstance(reason, Column) else F.col(reason)]


def rejection_focus(results: DataFrame, threshold: float = 7.5, k: int = 3,
                    keys: Sequence[str] = ("iteration", "prompt_family"), cfg: EvalConfig = _CFG) -> DataFrame:
    """Per prompt family, rejected / total, the top-k reasons with count
    and percent of rejected rows, and the recommendation for the top reason."""
    p = rejection_patterns(results, threshold, keys, cfg)
    ranked = top_reasons(p, k, keys)
    lines = ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "reason", "count", "pct_of_rejected"))).alias("_top"))
    sizes = results.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("sample_size"),
        F.count_if(F.col("overall_score") < threshold).cast("bigint").alias("rejected"))
    out = sizes.join(lines, list(keys), "left")
    top = F.col("_top")[0]["reason"]
    return out.select(*keys, "rejected", "sample_size",
                      F.array_join(F.transform("_top", lambda x: x["reason"]), ", ").alias("top_reasons"),
                      F.array_join(F.transform("_top", lambda x: x["count"].cast("string")), ", ").alias("top_counts"),
                      F.array_join(F.transform("_top", lambda x: F.concat(fixed(x["pct_of_rejected"], 0), F.lit("%"))),
                                   ", ").alias("top_percentages"),
                      top.alias("top_reason"), recommendation(top).alias("recommendation"))


def improvement_history(means: DataFrame, cfg: EvalConfig = _CFG) -> DataFrame:
    """K6 input / P19: metrics and the best example's score rounded to 3
    digits, plus the issue list."""
    cols = list(_MEANS) + ["avg_features"]
    out = means.withColumn("best_example", F.col("best_example").withField("score", F.round("best_example.score", 3)))
    return out.select(*[c for c in means.columns if c not in cols],
                      *[F.round(c, 3).alias(c) for c in cols], issue_list(means, cfg).alias("issues"))


def bool_export(df: DataFrame) -> DataFrame:
    """K7: boolean columns as 'TRUE' / 'FALSE' text (NULL stays NULL)."""
    repl = {f.name: F.when(F.col(f.name), F.lit("TRUE")).when(~F.col(f.name), F.lit("FALSE"))
            for f in df.schema.fields if f.dataType.typeName() == "boolean"}
    return df.withColumns(repl)
