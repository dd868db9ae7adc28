"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver tables through the stand-in views of
``proselens.sources.fixtures`` and runs library operators over the whole
tables.  Doubles are rounded to 6 places and nested values are rendered as
text so that results compare across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.config import EvalConfig
from proselens.operators import products as P
from proselens.operators import replies as R
from proselens.operators import report as RP
from proselens.operators import similarity as S
from proselens.operators.metrics import add_scores, attribute_text, combined_features
from proselens.operators.common import broadcast_if_small, referenced
from proselens.operators.requests import (expand_tasks, factcheck_requests, judge_requests, prompt_family, render_prompts,
                                          versioned_name)
from proselens.functions.jsonx import parse_list_text
from proselens.functions.vectors import cosine, l2_normalize
from proselens.sinks import writers as W
from proselens.sources import fixtures as FX
from proselens.sources import readers as RD
from proselens.sources.readers import series_gold

CFG = EvalConfig()
r6 = RP.r6


# --- results (candidates + scores + gates + labels) -------------------------

def results(spark: SparkSession, sf: str) -> DataFrame:
    return add_scores(FX.scored_candidates(spark, sf), CFG)


def q_length_compliance(spark, sf):
    c = FX.candidates(spark, sf).withColumn("in_range", F.col("char_len").between(CFG.min_chars, CFG.max_chars))
    return c.groupBy("iteration", "model").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_texts"),
        F.count_if("in_range").cast("bigint").alias("n_in_range"),
        r6(F.avg(F.col("in_range").cast("int"))).alias("compliance_rate"),
        r6(F.avg("char_len")).alias("avg_char_len"))


def q_overall_score(spark, sf):
    return results(spark, sf).select("candidate_ord", r6("overall_score").alias("overall_score"))


def q_quality_gates(spark, sf):
    return results(spark, sf).select("candidate_ord", "passed_quality_gates", "gate_failure_reason")


def q_rejection_labels(spark, sf):
    return results(spark, sf).select("candidate_ord", "rejection_reasons")


def q_rejection_patterns(spark, sf):
    return RP.rejection_patterns(results(spark, sf), CFG.report_threshold)


def q_rejection_totals(spark, sf):
    return RP.rejection_totals(results(spark, sf), CFG.report_threshold)


def q_top_issues(spark, sf):
    return RP.top_issues(results(spark, sf), CFG.optimize_threshold, 3)


def q_quality_summary(spark, sf):
    s = RP.quality_summary(results(spark, sf), CFG.report_threshold)
    pats = F.array_join(F.array_sort(F.transform(F.map_entries("all_patterns"),
                                                 lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return s.withColumn("all_patterns", pats)


def q_worst_example(spark, sf):
    return RP.worst_example(results(spark, sf), CFG.report_threshold)


def q_aggregate_by_run(spark, sf):
    return RP.aggregate_by_run(results(spark, sf))


def q_iteration_progress(spark, sf):
    return RP.iteration_progress(results(spark, sf), CFG.pass_level)


def q_failure_rates(spark, sf):
    return RP.failure_rates(FX.scored_candidates(spark, sf), ["model"])


def q_two_run_compare(spark, sf):
    return RP.failure_rates(FX.two_runs(spark, sf), ["dataset", "model"])


def q_score_box(spark, sf):
    return RP.box_stats(results(spark, sf), ["overall_score", "sbert"], ["iteration", "model"], CFG)


def q_length_histogram(spark, sf):
    return RP.length_histogram(FX.candidates(spark, sf), 20, ["iteration", "model"])


def q_score_curve(spark, sf):
    return RP.mean_by(add_scores(FX.two_runs(spark, sf)), ["dataset", "model", "iteration"], "overall_score",
                      "mean_overall_score")


def q_coverage_trend(spark, sf):
    return RP.mean_by(FX.scored_candidates(spark, sf), ["model", "iteration"],
                      "semantic_feature_coverage_normalized", "mean_coverage_normalized")


# --- replies ------------------------------------------------------------------

def parsed_replies(spark, sf) -> DataFrame:
    return R.parse_replies(FX.replies(spark, sf))


def q_parse_replies(spark, sf):
    return parsed_replies(spark, sf).select("candidate_ord", "kind", "status")


def q_reply_success_rate(spark, sf):
    g = R.generation_fields(parsed_replies(spark, sf).filter(F.col("kind") == "generation"))
    return R.success_rate(g, ["iteration", "model"])


def q_generation_candidates(spark, sf):
    g = R.valid_generations(parsed_replies(spark, sf).filter(F.col("kind") == "generation"))
    return g.select("candidate_ord", "header", "subheader", "marketing_text")


def q_judge_defaults(spark, sf):
    j = R.judge_fields(parsed_replies(spark, sf).filter(F.col("kind") == "judge"))
    return j.select("candidate_ord", "judge_score", "relevance_score", "generalization_score", "judge_reason")


def q_factcheck_defaults(spark, sf):
    f = R.factcheck_fields(parsed_replies(spark, sf).filter(F.col("kind") == "factcheck"))
    return f.select("candidate_ord", "has_hallucination", "hallucination_score",
                    F.size("hallucinated_claims").cast("bigint").alias("n_claims"),
                    F.get("hallucinated_claims", 0)["claim"].alias("first_claim"), "explanation")


# --- catalogue ------------------------------------------------------------------

def products(spark, sf) -> DataFrame:
    return P.load_products(FX.raw_products(spark, sf), FX.raw_descriptors(spark, sf))


def q_normalize_products(spark, sf):
    p = products(spark, sf)
    return p.select("product_id", "name", "series", F.size("features").cast("bigint").alias("n_features"),
                    F.array_join("features", " | ").alias("features_text"),
                    F.size("technical_data").cast("bigint").alias("n_specs"), "specs", "ibf_data")


def q_merge_features(spark, sf):
    p = P.normalize_products(P.lower_columns(FX.raw_products(spark, sf)))
    return p.select("product_id", F.posexplode("features").alias("pos", "feature")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def q_tech_specs(spark, sf):
    p = P.normalize_products(P.lower_columns(FX.raw_products(spark, sf)))
    return p.select("product_id", F.explode("technical_data").alias("spec_key", "spec_value"))


def q_specs_text(spark, sf):
    p = P.normalize_products(P.lower_columns(FX.raw_products(spark, sf)))
    return p.select("product_id", "specs")


def q_descriptor_blocks(spark, sf):
    return P.descriptor_blocks(FX.raw_descriptors(spark, sf))


def enriched(spark, sf) -> DataFrame:
    raw = P.rename_present(P.lower_columns(FX.raw_products(spark, sf)), P.PRODUCT_RENAMES)
    return P.enrich(raw, P.descriptor_blocks(FX.raw_descriptors(spark, sf)))


def q_enrich_products(spark, sf):
    e = enriched(spark, sf)
    return e.select(F.col("product_id").cast("string").alias("product_id"), "ibf_match", "ibf_data")


def q_enrich_match_rate(spark, sf):
    return P.match_rate(enriched(spark, sf))


# Prompt families, enabled models and the template used by the
# request queries.
PROMPTS = {
    "prompt": "Write a product text for {name} ({series}).\nFeatures: {features}\nSpecs: {specs}\n"
              "{ibf_data}\nAnswer as JSON with {header}, {subheader} and {{marketing_text}}.",
    "prompt2": "Describe {name} of the {series} range in 450 to 600 characters. Use: {features}; {specs}.",
}
MODELS = ["model_a", "model_b"]


def q_prompt_tasks(spark, sf):
    t = expand_tasks(products(spark, sf), PROMPTS, MODELS, iteration=0)
    return t.select("product_id", "prompt_family", "prompt_name", "model")


def q_render_prompt(spark, sf):
    t = expand_tasks(products(spark, sf), PROMPTS, MODELS[:1], iteration=0)
    return render_prompts(t).select("product_id", "prompt_family", "user_prompt")


def q_attribute_text(spark, sf):
    return products(spark, sf).select("product_id", attribute_text().alias("attribute_text"))


def q_combined_features(spark, sf):
    p = products(spark, sf).select("product_id", combined_features().alias("combined"))
    return p.select("product_id", F.size("combined").cast("bigint").alias("n_combined"),
                    F.array_join("combined", " | ").alias("combined_text"))


# --- similarity -------------------------------------------------------------------

def _cand_products(spark, sf):
    c = FX.candidates(spark, sf).select("candidate_ord", "product_id", "marketing_text")
    p = referenced(products(spark, sf), "product_id", c).select(
        "product_id", attribute_text().alias("attribute_text"), combined_features().alias("combined"))
    return c, p


def q_attribute_alignment(spark, sf):
    c, p = _cand_products(spark, sf)
    out = S.paired_cosine(c, "candidate_ord", "marketing_text", p, "product_id", "attribute_text",
                          "semantic_attribute_alignment")
    return out.select("candidate_ord", r6("semantic_attribute_alignment").alias("semantic_attribute_alignment"))


def q_paired_gold_similarity(spark, sf):
    c = FX.with_gold(FX.candidates(spark, sf).select("candidate_ord", "marketing_text"), spark, sf)
    out = S.paired_cosine(c, "candidate_ord", "marketing_text", FX.gold(spark, sf), "gold_id", "marketing_text",
                          "semantic_similarity_gold")
    return out.select("candidate_ord", r6("semantic_similarity_gold").alias("semantic_similarity_gold"))


def q_max_gold_similarity(spark, sf):
    c = FX.candidates(spark, sf)
    out = S.max_reference_similarity(c, "candidate_ord", "marketing_text", FX.gold(spark, sf), "gold_id",
                                     "marketing_text", "sbert")
    return out.select("candidate_ord", r6("sbert").alias("sbert"))


def coverage(spark, sf) -> DataFrame:
    c, p = _cand_products(spark, sf)
    return S.feature_coverage(c, "candidate_ord", "marketing_text", p, "product_id", "combined",
                              CFG.coverage_threshold)


def q_feature_coverage(spark, sf):
    return coverage(spark, sf).withColumn("semantic_feature_coverage", r6("semantic_feature_coverage"))


def q_coverage_normalized(spark, sf):
    from proselens.functions.scoring import normalize_coverage
    cv = coverage(spark, sf)
    return cv.select("candidate_ord", "n_features", r6("semantic_feature_coverage").alias("semantic_feature_coverage"),
                     r6(normalize_coverage("semantic_feature_coverage", "n_features"))
                     .alias("semantic_feature_coverage_normalized"))


def q_vector_cosine_topk(spark, sf, k: int = 5):
    """X3/X5 on dense vectors: per label, the k vectors closest (cosine) to
    the label centroid, the mean of the L2-normalised vectors of the label.

    Centroids come from a per-(label, dimension) aggregation; each vector is
    paired with its own label's centroid by an equi-join, so the work is
    linear in the vectors.  Ties go to the smaller ``vec_id``.
    """
    from pyspark.sql import Window
    e = FX.table(spark, sf, "embeddings").select("vec_id", "label", l2_normalize("embedding").alias("v"))
    dims = e.select("label", F.posexplode("v").alias("i", "x"))
    cent = dims.groupBy("label", "i").agg(F.avg("x").alias("x")) \
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_c")) \
        .select("label", F.transform("_c", lambda s: s["x"]).alias("c"))
    # one centroid per label, broadcast only within the checked bound
    sims = e.join(broadcast_if_small(cent), "label").select("label", "vec_id", cosine("v", "c").alias("cosine"))
    w = Window.partitionBy("label").orderBy(F.desc("cosine"), F.asc("vec_id"))
    top = sims.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select("label", F.col("rank").cast("int").alias("rank"), "vec_id", r6("cosine").alias("cosine"))


def q_series_gold_last(spark, sf):
    return series_gold(FX.raw_series_gold(spark, sf))


def q_bool_export(spark, sf):
    r = results(spark, sf).select("candidate_ord", "in_range", "has_hallucination", "passed_quality_gates",
                                  "is_unique")
    return RP.bool_export(r)


# --- improvement report -------------------------------------------------------------

def q_prompt_means(spark, sf):
    m = RP.prompt_means(results(spark, sf))
    cols = [c for c in m.columns if c.startswith("avg_")]
    return m.select("iteration", "prompt_family", *[r6(c).alias(c) for c in cols], "sample_size")


def q_best_example(spark, sf):
    m = RP.prompt_means(results(spark, sf))
    return m.select("iteration", "prompt_family", "best_example.product_id",
                    r6("best_example.score").alias("score"), F.col("best_example.length").alias("length"),
                    "best_example.model")


def q_issue_report(spark, sf):
    m = RP.prompt_means(results(spark, sf))
    return m.select("iteration", "prompt_family", F.posexplode(RP.issue_list(m, CFG)).alias("issue_pos", "issue")) \
        .withColumn("issue_pos", F.col("issue_pos").cast("bigint"))


def q_recommendations(spark, sf):
    return RP.rejection_focus(results(spark, sf), CFG.optimize_threshold, 3)


def q_improvement_history(spark, sf):
    h = RP.improvement_history(RP.prompt_means(results(spark, sf)), CFG)
    return h.select("iteration", "prompt_family", *[c for c in h.columns if c.startswith("avg_")], "sample_size",
                    F.col("best_example.score").alias("best_score"), F.array_join("issues", " | ").alias("issues"))


def q_quality_report(spark, sf):
    s = FX.scored_candidates(spark, sf).withColumnRenamed("sbert", "semantic_similarity_gold")
    return RP.quality_report(s)




# --- duplicate detection ------------------------------------------------------------

def q_unique_texts(spark, sf):
    from proselens.operators.dedup import duplicate_flags
    d = duplicate_flags(FX.candidates(spark, sf), threshold=CFG.dedup_threshold_eval, cfg=CFG)
    return d.withColumn("duplicate_similarity", r6("duplicate_similarity"))


def q_unique_per_iteration(spark, sf):
    from proselens.operators.dedup import duplicate_flags
    d = duplicate_flags(FX.candidates(spark, sf), partition=["iteration"], threshold=CFG.dedup_threshold_final,
                        cfg=CFG)
    return d.withColumn("duplicate_similarity", r6("duplicate_similarity"))


def q_duplicate_rate(spark, sf):
    from proselens.operators.dedup import duplicate_flags
    d = duplicate_flags(FX.candidates(spark, sf), partition=["iteration"], threshold=CFG.dedup_threshold_final,
                        cfg=CFG)
    return RP.duplicate_rate(d)


def q_lexical_duplicates(spark, sf):
    """Rows whose word set occurs more than once: the first row and the group
    size, from one aggregation on a set signature (no pairs)."""
    from proselens.functions.text import word_tokens
    c = FX.candidates(spark, sf).select(
        "candidate_ord", F.sha2(F.array_join(F.array_sort(F.array_distinct(word_tokens("marketing_text"))), " "),
                                256).alias("_sig"))
    g = c.groupBy("_sig").agg(F.min("candidate_ord").alias("first_ord"),
                              F.count(F.lit(1)).cast("bigint").alias("group_size")).filter("group_size > 1")
    return c.join(g, "_sig").select("candidate_ord", "first_ord", "group_size")


# --- one iteration end to end (H4) -------------------------------------------------

def q_iteration_results(spark, sf):
    """Reply table -> valid texts -> measures, judge and fact-check fields ->
    composite score, gates and labels (one row per valid generated text)."""
    from proselens.plans.iteration import iteration_results
    res = iteration_results(FX.text_replies(spark, sf), products(spark, sf), FX.gold(spark, sf), CFG)
    dbl = ["judge_score", "relevance_score", "generalization_score", "hallucination_score",
           "semantic_attribute_alignment", "semantic_feature_coverage", "semantic_feature_coverage_normalized",
           "sbert", "overall_score"]
    return res.select("candidate_ord", "iteration", "model", "product_id", "prompt_name", "char_len", "in_range",
                      "judge_reason", "has_hallucination", *[r6(c).alias(c) for c in dbl],
                      "passed_quality_gates", "gate_failure_reason", "rejection_reasons")


def q_evaluate_texts(spark, sf):
    """H3: attribute alignment, paired gold similarity, feature coverage and
    duplicate flags (0.99) for every candidate, in one evaluation plan."""
    from proselens.plans.evaluate import evaluate_texts
    c = FX.with_gold(FX.candidates(spark, sf).select("candidate_ord", "product_id", "marketing_text"), spark, sf)
    ev = evaluate_texts(c, products(spark, sf), gold=FX.gold(spark, sf), cfg=CFG)
    return ev.select("candidate_ord", r6("semantic_attribute_alignment").alias("semantic_attribute_alignment"),
                     r6("semantic_similarity_gold").alias("semantic_similarity_gold"),
                     r6("semantic_feature_coverage").alias("semantic_feature_coverage"), "num_features",
                     "is_unique", "duplicate_of_candidate", r6("duplicate_similarity").alias("duplicate_similarity"))


# --- readers, sinks and report sets on files -------------------------------------------

def _folder(spark, name: str) -> str:
    """A fresh folder for files under the shared one."""
    import uuid

    from proselens.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_load_counts(spark, sf):
    """A24 over S1, S2, S3: rows of each loaded table; no descriptors given counts 0."""
    gold = RD.gold_texts(RD.read_table(spark, f"{sf}/benchmark.parquet").withColumnRenamed("text", "marketing_text"))
    return RD.load_counts(products=RD.read_product_export(spark, f"{sf}/part.parquet"),
                          descriptors=RD.read_descriptors(spark, f"{sf}/benchmark.parquet"), gold=gold,
                          series_gold=RD.read_descriptors(spark, None))


def q_generated_ids(spark, sf):
    """S1 + P4: an export without ids; the file is in order of ``p_partkey``."""
    raw = RD.read_product_export(spark, f"{sf}/part.parquet").drop("p_partkey")
    return P.normalize_products(raw.withColumnRenamed("p_name", "Product designation")).select("product_id", "name")


def q_series_gold_file_order(spark, sf):
    """Two columns only; the last text of a series in file order wins."""
    path = _folder(spark, "series-gold")
    FX.raw_series_gold(spark, sf).orderBy("ord").select("series", "marketing_text").coalesce(1).write.parquet(path)
    return RD.read_series_gold(spark, path)


def q_standard_products(spark, sf):
    """S5 + X6: written standard products with features as list text, read back."""
    path = _folder(spark, "standard")
    products(spark, sf).select("product_id", "name", F.to_json("features").alias("features")).write.parquet(path)
    p = RD.read_standard_products(spark, path)
    return p.select("product_id", F.size("features").cast("bigint").alias("n_features"),
                    F.array_join("features", " | ").alias("features_text"))


def q_list_features(spark, sf):
    """List texts with both quotes, a plain text and an empty one."""
    d = F.col("doc_id")
    t = (F.when(d % 4 == 0, F.concat(F.lit('["it\'s '), "lang", F.lit('", \''), "source", F.lit("', 7]")))
         .when(d % 4 == 1, F.concat(F.lit("[ '"), "lang", F.lit("' ]"))).when(d % 4 == 2, F.concat(F.lit("["), "lang"))
         .otherwise(F.lit("")))
    f = FX.table(spark, sf, "documents").select("doc_id", parse_list_text(t).alias("f"))
    return f.select("doc_id", F.size("f").cast("bigint").alias("n"), F.array_join("f", " | ").alias("features"))


def q_nan_scores(spark, sf):
    """NaN, blank and junk judge scores never pass the gates."""
    d = F.col("candidate_ord")
    score = F.when(d % 4 == 0, "NaN").when(d % 4 == 1, "").when(d % 4 == 2, "8.5").otherwise("high")
    c = FX.candidates(spark, sf).select("candidate_ord", F.concat(
        F.lit('{"overall_score": "'), score, F.lit('", "relevance_score": 4, "generalization_score": 4}')).alias("raw"))
    j = R.judge_fields(R.parse_replies(c)).withColumns({
        "hallucination_score": F.lit(9.0), "semantic_attribute_alignment": F.lit(0.9), "in_range": F.lit(True),
        "semantic_feature_coverage_normalized": F.lit(1.0), "char_len": F.lit(500)})
    return add_scores(j, CFG).select("candidate_ord", "judge_score", r6("overall_score").alias("overall_score"),
                                     "passed_quality_gates")


def _written_runs(spark, sf) -> DataFrame:
    """K1 twice, S7 + U3: two result folders read as one tagged table."""
    r = results(spark, sf)
    paths = {"with_reference": _folder(spark, "run"), "without_reference": _folder(spark, "run")}
    W.write_results(r.filter("lang = 'en'"), paths["with_reference"])
    W.write_results(r.filter("lang <> 'en'"), paths["without_reference"])
    return RD.read_results(spark, paths)


def _run_means(r: DataFrame, *keys: str) -> DataFrame:
    return r.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"), r6(F.avg("overall_score")).alias("mean_score"))


def q_written_runs(spark, sf):
    return _run_means(_written_runs(spark, sf), "dataset", "iteration")


def q_rewritten_results(spark, sf):
    """K1: a second write of fewer iterations leaves none of the first."""
    path = _folder(spark, "rewritten")
    r = results(spark, sf)
    W.write_results(r, path)
    W.write_results(r.filter("iteration < 2"), path)
    return _run_means(RD.read_table(spark, path), "iteration")


def q_rerun_iteration(spark, sf):
    """K3: writing iteration 1 again replaces that one only."""
    path = _folder(spark, "checkpoints")
    r = results(spark, sf)
    W.write_iteration_checkpoint(r, path)
    W.write_iteration_checkpoint(r.filter("iteration = 1 and lang = 'en'"), path)
    return _run_means(RD.read_table(spark, path), "iteration")


def q_history_rerun(spark, sf):
    """K6: the history of an iteration written twice is there once."""
    path = _folder(spark, "history")
    h = RP.improvement_history(RP.prompt_means(results(spark, sf)), CFG)
    W.append_history(h, path)
    W.append_history(h.filter("iteration = 1"), path)
    back = RD.read_table(spark, path, "json")
    return back.select(F.col("iteration").cast("int").alias("iteration"), "prompt_family", r6("avg_score").alias("avg_score"),
                       "sample_size")


def q_aggregate_file(spark, sf):
    """K2: the aggregate table written and read."""
    path = _folder(spark, "aggregate")
    W.write_aggregate(RP.aggregate_by_run(results(spark, sf)), path)
    return RD.read_table(spark, path)


def q_summary_file(spark, sf):
    """K4: the summary as JSON, read back without its time of writing."""
    path = _folder(spark, "summary")
    W.write_summary_json(RP.quality_summary(results(spark, sf), CFG.report_threshold), path)
    return RD.read_table(spark, path, "json").select("total_outputs", "rejected_count",
                                                     r6("rejection_rate").alias("rejection_rate"), "top_issue")


def q_union_iterations(spark, sf):
    """Iterations with different columns as one table."""
    from proselens.plans.reports import union_iterations
    r = results(spark, sf)
    frames = [r.filter(F.col("iteration") == i).select("iteration", "overall_score", *(["judge_score"] if i % 2 else []))
              for i in range(4)]
    return union_iterations([None, *frames]).groupBy("iteration").agg(
        F.count("overall_score").cast("bigint").alias("n_scores"), F.count("judge_score").cast("bigint").alias("n_judged"))


def q_prompt_families(spark, sf):
    """families of versioned names, one the beginning of the other."""
    it = F.col("iteration")
    name = versioned_name(F.when(F.col("model") == "model_a", "prompt").otherwise("prompt2"), it)
    return FX.candidates(spark, sf).groupBy(prompt_family(name).alias("family")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def _written(df: DataFrame) -> DataFrame:
    """The results written once; every table of a report set reads them."""
    from proselens.operators.common import materialize
    return materialize(df, "report-results")


def q_optimisation_report(spark, sf):
    """H5: all four tables, a row per cell."""
    from proselens.plans.reports import long_form, optimisation_report
    return long_form(optimisation_report(_written(results(spark, sf)), CFG))


def q_final_report(spark, sf):
    """H6: all eight tables, a row per cell; of the results the scores and the
    new duplicate flags."""
    from proselens.plans.reports import final_report, long_form
    tables = final_report(_written(results(spark, sf)), CFG)
    kept = ["iteration", "candidate_ord", "overall_score", "passed_quality_gates", "is_unique", "duplicate_of"]
    return long_form(tables | {"results": tables["results"].select(*kept)})


def q_figure_tables(spark, sf):
    """H7: all five tables, a row per cell."""
    from proselens.plans.reports import figure_tables, long_form
    return long_form(figure_tables(_written(add_scores(FX.two_runs(spark, sf))), CFG))


# The texts around what a reviewer gets to see.
JUDGE_TEMPLATE = ("Rate this text ({char_len} characters, {min_chars} to {max_chars} allowed, in range: {in_range}; alignment "
                  "{semantic_attribute_alignment}, coverage {semantic_feature_coverage_normalized}).\n{candidate}")
FACTCHECK_TEMPLATE = "Check every claim against {name} ({series}).\nFeatures: {features}\nData: {specs}\n{candidate}"


def q_judge_requests(spark, sf):
    r = judge_requests(FX.scored_candidates(spark, sf), JUDGE_TEMPLATE, CFG)
    return r.select("candidate_ord", "request")


def q_factcheck_requests(spark, sf):
    r = factcheck_requests(FX.candidates(spark, sf), products(spark, sf), FACTCHECK_TEMPLATE)
    return r.select("candidate_ord", "request")


def q_own_gold_similarity(spark, sf):
    """The gold text that a row itself carries."""
    g = FX.gold(spark, sf).select("gold_id", F.col("marketing_text").alias("gold_text"))
    c = FX.with_gold(FX.candidates(spark, sf), spark, sf).join(g, "gold_id", "left")
    out = S.own_cosine(c, "candidate_ord", "marketing_text", "gold_text", "semantic_similarity_gold")
    return out.select("candidate_ord", r6("semantic_similarity_gold").alias("semantic_similarity_gold"))


def _first_vectors(spark, sf) -> DataFrame:
    return FX.table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))


def q_paired_vector_cosine(spark, sf):
    """X4 / J8 on vectors: each vector against the first one of its label."""
    e = FX.table(spark, sf, "embeddings").join(broadcast_if_small(_first_vectors(spark, sf)), "label")
    as_double = lambda c: F.col(c).cast("array<double>")
    return e.select("vec_id", r6(cosine(as_double("embedding"), as_double("ref"))).alias("cosine"))


def q_best_vector_reference(spark, sf):
    """A18 on vectors: the best of the labels' first vectors."""
    from proselens.operators.encoders import max_dense_similarity
    out = max_dense_similarity(FX.table(spark, sf, "embeddings"), "vec_id", "embedding", _first_vectors(spark, sf), "ref",
                               "best")
    return out.select("vec_id", r6("best").alias("best"))


# --- encoders and the scorer hook -----------------------------------------------------

def _hashed_model():
    """M1 (c): the small deterministic model, loaded in the workers."""
    from proselens.operators.encoders import HashedWords, UserModel
    return UserModel(HashedWords)


def q_model_alignment(spark, sf):
    """M1 (c), A22, X4: distinct texts through the model once, each candidate
    against its product's attribute text."""
    from proselens.operators.encoders import TextVectors, paired_vectors
    c, p = _cand_products(spark, sf)
    vectors = TextVectors(_hashed_model(), [(c, "marketing_text"), (p, "attribute_text")])
    out = paired_vectors(c, "candidate_ord", "marketing_text", p, "product_id", "attribute_text",
                         "semantic_attribute_alignment", vectors)
    return out.select("candidate_ord", r6("semantic_attribute_alignment").alias("semantic_attribute_alignment"))


def q_model_feature_coverage(spark, sf):
    """A17, A22, J6 on vectors."""
    from proselens.operators.encoders import TextVectors, vector_coverage
    from proselens.operators.measures import features_of
    c, p = _cand_products(spark, sf)
    vectors = TextVectors(_hashed_model(), [(c, "marketing_text"), (features_of(p, "combined"), "feature")])
    out = vector_coverage(c, "candidate_ord", "marketing_text", p, "product_id", "combined", CFG.coverage_threshold, vectors)
    return out.withColumn("semantic_feature_coverage", r6("semantic_feature_coverage"))


def q_model_unique_texts(spark, sf):
    """D1 / D2 by the vectors of the model."""
    from proselens.operators.dedup import duplicate_flags
    d = duplicate_flags(FX.candidates(spark, sf), threshold=CFG.dedup_threshold_eval, cfg=CFG, encoder=_hashed_model())
    return d.withColumn("duplicate_similarity", r6("duplicate_similarity"))


def _embedded_texts(spark, sf) -> DataFrame:
    """M1 (a): texts with vectors from ``embeddings``; many texts have none."""
    return FX.table(spark, sf, "documents").select("doc_id", "text").join(
        FX.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


def q_vector_unique_texts(spark, sf):
    """D1 by vectors made elsewhere: of the pairs whose words overlap enough,
    those whose vectors do not point apart."""
    from proselens.operators.dedup import duplicate_flags
    from proselens.operators.encoders import VectorTable
    d = duplicate_flags(FX.candidates(spark, sf), threshold=0.0, cfg=CFG,
                        encoder=VectorTable(_embedded_texts(spark, sf), "text", "embedding"))
    return d.withColumn("duplicate_similarity", r6("duplicate_similarity"))


def q_model_evaluate_texts(spark, sf):
    """H3 by the model instead of term counts."""
    from proselens.plans.evaluate import evaluate_texts
    c = FX.with_gold(FX.candidates(spark, sf).select("candidate_ord", "product_id", "marketing_text"), spark, sf)
    ev = evaluate_texts(c, products(spark, sf), gold=FX.gold(spark, sf), cfg=CFG, encoder=_hashed_model())
    return ev.select("candidate_ord", r6("semantic_attribute_alignment").alias("semantic_attribute_alignment"),
                     r6("semantic_similarity_gold").alias("semantic_similarity_gold"),
                     r6("semantic_feature_coverage").alias("semantic_feature_coverage"), "num_features",
                     "is_unique", "duplicate_of_candidate", r6("duplicate_similarity").alias("duplicate_similarity"))


def q_model_iteration_results(spark, sf):
    """H4 by the model instead of term counts."""
    from proselens.plans.iteration import iteration_results
    res = iteration_results(FX.text_replies(spark, sf), products(spark, sf), FX.gold(spark, sf), CFG, encoder=_hashed_model())
    dbl = ["semantic_attribute_alignment", "semantic_feature_coverage", "sbert", "overall_score"]
    return res.select("candidate_ord", *[r6(c).alias(c) for c in dbl], "passed_quality_gates", "rejection_reasons")


class LengthJudge:
    """A deterministic judge: scores a request by its length, gives some no
    reply and fails on others."""

    def __call__(self, texts: list[str]) -> list[str | None]:
        if any(len(t) % 13 == 0 for t in texts):
            raise ValueError("unlucky request")
        return [None if len(t) % 17 == 0 else
                f'{{"overall_score": {6 + len(t) % 4}, "relevance_score": {1 + len(t) % 5}, '
                f'"generalization_score": "{2 + len(t) % 3}", "reason": "length {len(t)}"}}' for t in texts]


def q_scored_requests(spark, sf):
    """M2-M4: judge requests through the scorer hook, replies parsed."""
    from proselens.operators.scorer import score_requests
    requests = judge_requests(FX.scored_candidates(spark, sf), JUDGE_TEMPLATE, CFG).select("candidate_ord", "request")
    replies = score_requests(requests, LengthJudge, _folder(spark, "judge-journal")).withColumnRenamed("status", "call_status")
    return R.judge_fields(R.parse_replies(replies)).select(
        "candidate_ord", "call_status", "error", "judge_score", "relevance_score", "generalization_score", "judge_reason")


QUERIES = {name[2:]: fn for name, fn in dict(globals()).items() if name.startswith("q_")}
