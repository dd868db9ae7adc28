"""Same results for 1, 4 and 64 shuffle partitions; empty inputs give empty outputs."""

import pytest
from pyspark.sql import functions as F

from compare import canon
from conftest import SF001
from proselens.config import EvalConfig
from proselens.operators import report as RP
from proselens.operators import similarity as S
from proselens.operators.metrics import add_scores
from proselens.operators.replies import judge_fields, parse_replies
from proselens.plans import catalog
from proselens.sources import fixtures as FX

QUERIES = ["rejection_patterns", "top_issues", "score_box", "length_histogram", "attribute_alignment",
           "feature_coverage", "max_gold_similarity", "descriptor_blocks", "vector_cosine_topk", "recommendations"]


def run(spark, name, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = catalog.QUERIES[name](spark, SF001)
        return canon(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", QUERIES)
def test_partition_invariance(spark, name):
    base = run(spark, name, 1)
    assert run(spark, name, 4) == base
    assert run(spark, name, 64) == base


def test_empty_inputs(spark):
    cfg = EvalConfig()
    scored = FX.scored_candidates(spark, SF001).limit(0)
    res = add_scores(scored, cfg)
    assert res.count() == 0
    for df in [RP.aggregate_by_run(res), RP.rejection_patterns(res), RP.top_issues(res), RP.worst_example(res),
               RP.iteration_progress(res), RP.failure_rates(res), RP.length_histogram(res),
               RP.prompt_means(res), RP.rejection_focus(res), RP.quality_summary(res),
               RP.duplicate_rate(res.withColumn("is_unique", F.lit(True)))]:
        assert df.count() == 0
    assert RP.box_stats(res).count() == 0
    assert RP.rejection_totals(res).first()["total"] == 0
    c = FX.candidates(spark, SF001).limit(0)
    assert S.max_reference_similarity(c, "candidate_ord", "marketing_text", FX.gold(spark, SF001), "gold_id",
                                      "marketing_text").count() == 0
    p = catalog.products(spark, SF001)
    assert S.paired_cosine(c, "candidate_ord", "marketing_text", p.withColumn("t", F.lit("x")), "product_id", "t",
                           "s").count() == 0
    assert judge_fields(parse_replies(FX.replies(spark, SF001).limit(0))).count() == 0
