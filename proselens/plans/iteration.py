"""H4: result rows of one optimisation iteration.

Inputs are tables: the generation tasks (product x prompt x model), the raw
model replies (generation, judge, factcheck) and the products; gold texts
are optional.  Output: one row per valid generated text with the measures,
the composite score, the gate result and the rejection labels - the result
table of the evaluated pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.config import EvalConfig
from proselens.operators import replies as R
from proselens.operators.common import materialize, referenced
from proselens.operators import encoders as E
from proselens.operators.measures import features_of, measures
from proselens.operators.metrics import add_scores, attribute_text, combined_features, length_measures
from proselens.functions.scoring import normalize_coverage
from proselens.operators.requests import prompt_family

KEY = ["iteration", "model", "product_id", "prompt_name"]


def iteration_results(replies: DataFrame, products: DataFrame, gold: DataFrame | None = None,
                      cfg: EvalConfig = EvalConfig(), key: str = "candidate_ord",
                      encoder: E.Encoder | None = None) -> DataFrame:
    """Similarities by term counts, or by the vectors of ``encoder`` (M1).
    ``replies``: (key, iteration, model, product_id, prompt_name, kind, raw)."""
    parsed = R.parse_replies(replies)
    gen = R.valid_generations(parsed.filter(F.col("kind") == "generation")) \
        .select(key, *KEY, "header", "subheader", "marketing_text")
    judge = R.judge_fields(parsed.filter(F.col("kind") == "judge")) \
        .select(key, "judge_score", "relevance_score", "generalization_score", "judge_reason",
                F.lit(True).alias("_judge"))
    fact = R.factcheck_fields(parsed.filter(F.col("kind") == "factcheck")) \
        .select(key, "has_hallucination", "hallucination_score",
                F.to_json("hallucinated_claims").alias("hallucinated_claims"), F.lit(True).alias("_fact"))
    # parsed once, read by every measure
    cands = materialize(length_measures(gen, cfg), "iteration-texts")
    prod = referenced(products, "product_id", cands).select("product_id", attribute_text().alias("attribute_text"),
                           combined_features().alias("combined"))
    by = measures(encoder, [(cands, "marketing_text"), (prod, "attribute_text"), (features_of(prod, "combined"), "feature")]
                  + ([(gold, "marketing_text")] if gold is not None else []))
    # a number per text stays of each; the texts and vectors that its join has moved go
    align, cov, sbert = (materialize(m, "iteration-measure") for m in (
        by.paired(cands, key, "marketing_text", prod, "product_id", "attribute_text", "semantic_attribute_alignment"),
        by.coverage(cands, key, "marketing_text", prod, "product_id", "combined", cfg.coverage_threshold),
        by.best(cands, key, "marketing_text", gold, "gold_id", "marketing_text", "sbert")))
    by.release()
    rows = (cands.join(align, key, "left").join(cov, key, "left").join(sbert, key, "left")
            .join(judge, key, "left").join(fact, key, "left"))
    rows = rows.withColumns({
        "semantic_feature_coverage_normalized": normalize_coverage("semantic_feature_coverage", "n_features"),
        "num_features": F.col("n_features"),
        "judge_score_secondary": F.lit(None).cast("double"),
        "relevance_score_secondary": F.lit(None).cast("double"),
        "generalization_score_secondary": F.lit(None).cast("double"),
        # defaults of the row builder: a candidate without a judge / factcheck row
        "judge_reason": F.when(F.col("_judge").isNull(), F.lit("")).otherwise(F.col("judge_reason")),
        "hallucination_score": F.when(F.col("_fact").isNull(), F.lit(10.0)).otherwise(F.col("hallucination_score")),
        "hallucinated_claims": F.coalesce("hallucinated_claims", F.lit("[]")),
        "sbert": F.coalesce("sbert", F.lit(0.0)),
        # prompt family = versioned prompt name without its "_iterN" suffix
        "prompt_family": prompt_family("prompt_name"),
    })
    return add_scores(rows.drop("_fact", "_judge"), cfg)
