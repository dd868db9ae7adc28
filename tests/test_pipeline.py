"""Compositions, sinks, streaming and encoders on the small test tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from proselens.operators import encoders as E
from proselens.operators import report as RP
from proselens.operators.common import materialize
from proselens.operators.products import load_products
from proselens.plans import catalog
from proselens.plans.evaluate import evaluate_texts
from proselens.plans.iteration import iteration_results
from proselens.plans.reports import figure_tables, final_report, optimisation_report
from proselens.sinks import writers as W
from proselens.sources import fixtures as FX
from proselens.streaming import replies as SR


@pytest.fixture(scope="module")
def products(spark):
    return load_products(FX.raw_products(spark, SF001), FX.raw_descriptors(spark, SF001))


@pytest.fixture(scope="module")
def results(spark, products):
    reps = FX.replies(spark, SF001)
    gen_ok = reps.filter("kind = 'generation'")
    # generated texts are the documents: replace the generation reply by one holding the document text
    docs = FX.candidates(spark, SF001).select("candidate_ord", "marketing_text")
    gen = gen_ok.join(docs, "candidate_ord").withColumn(
        "raw", F.to_json(F.struct(F.lit("H").alias("header"), F.lit("S").alias("subheader"),
                                  F.col("marketing_text")))).drop("marketing_text")
    allr = gen.unionByName(reps.filter("kind <> 'generation'"))
    # an iteration's results are written once (the per-iteration checkpoint)
    return materialize(iteration_results(allr, products, FX.gold(spark, SF001)), "test-results")


def test_iteration_results(spark, results):
    cols = set(results.columns)
    for c in ["iteration", "model", "product_id", "prompt_name", "header", "subheader", "marketing_text", "char_len",
              "in_range", "sbert", "judge_score", "relevance_score", "generalization_score", "judge_reason",
              "has_hallucination", "hallucination_score", "hallucinated_claims", "semantic_feature_coverage",
              "semantic_feature_coverage_normalized", "semantic_attribute_alignment", "overall_score",
              "passed_quality_gates", "gate_failure_reason", "rejection_reasons"]:
        assert c in cols, c
    rows = results.collect()
    assert len(rows) == FX.candidates(spark, SF001).count()
    for r in rows:
        assert 0.0 <= r["semantic_attribute_alignment"] <= 1.0 + 1e-12
        assert (r["gate_failure_reason"] == "") == r["passed_quality_gates"]
        assert (r["rejection_reasons"] == "") == r["passed_quality_gates"]


def test_evaluate_texts(spark, products):
    c = FX.candidates(spark, SF001).select("candidate_ord", "product_id", "marketing_text",
                                          (F.col("candidate_ord") % 40).alias("gold_id"))
    ev = evaluate_texts(c, products, gold=FX.gold(spark, SF001)).collect()
    assert len(ev) == c.count()
    assert all(r["is_unique"] is not None for r in ev)
    empty = evaluate_texts(c.limit(0), products)
    assert empty.count() == 0


def test_reports(spark, results):
    opt = optimisation_report(results)
    assert opt["prompt_means"].count() == results.select("iteration", "prompt_family").distinct().count()
    assert opt["improvement_history"].count() == opt["prompt_means"].count()
    fin = final_report(results)
    assert fin["duplicate_rate"].count() == results.select("iteration").distinct().count()
    assert fin["quality_summary"].count() == 1
    runs = results.withColumn("dataset", F.lit("a")).withColumn("is_unique", F.lit(True))
    figs = figure_tables(runs)
    assert figs["length_histogram"].groupBy("iteration", "model").count().filter("count != 20").count() == 0


def test_sinks_roundtrip(spark, results, tmpdir_path):
    p = os.path.join(tmpdir_path, "results")
    W.write_results(results, p)
    back = spark.read.parquet(p)
    assert back.count() == results.count()
    # checkpoint of one iteration replaces only its partition
    W.write_iteration_checkpoint(results.filter("iteration = 0").limit(3), p)
    assert spark.read.parquet(p).filter("iteration = 0").count() == 3
    assert spark.read.parquet(p).filter("iteration = 1").count() == results.filter("iteration = 1").count()
    summ = os.path.join(tmpdir_path, "summary")
    W.write_summary_json(RP.quality_summary(results), summ)
    assert spark.read.json(summ).count() == 1
    hist = os.path.join(tmpdir_path, "history")
    means = RP.prompt_means(results)
    W.append_history(RP.improvement_history(means), hist)
    W.append_history(RP.improvement_history(means), hist)
    assert spark.read.json(hist).count() == means.count()  # a re-run replaces its iterations
    csv = os.path.join(tmpdir_path, "csv")
    W.write_text_booleans(results.select("in_range", "passed_quality_gates"), csv)
    vals = {r[0] for r in spark.read.option("header", True).csv(csv).select("in_range").collect()}
    assert vals <= {"TRUE", "FALSE", None}


def test_streaming_replies(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    FX.replies(spark, SF001).write.parquet(src)
    out = os.path.join(tmpdir_path, "out")
    q = SR.write_partitioned(SR.parsed_judge_stream(SR.reply_stream(spark, src)), out,
                             os.path.join(tmpdir_path, "ckpt"), trigger_once=True)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = catalog.q_judge_defaults(spark, SF001)
    assert got.count() == batch.count()
    a = {(r["candidate_ord"], r["judge_reason"]) for r in got.collect()}
    b = {(r["candidate_ord"], r["judge_reason"]) for r in batch.collect()}
    assert a == b
    fout = os.path.join(tmpdir_path, "fact")
    q2 = SR.write_partitioned(SR.parsed_factcheck_stream(SR.reply_stream(spark, src)), fout,
                              os.path.join(tmpdir_path, "ckpt2"), trigger_once=True)
    q2.awaitTermination(300)
    fb = {r["candidate_ord"]: (r["hallucination_score"], r["explanation"])
          for r in catalog.q_factcheck_defaults(spark, SF001).collect()}
    fs = {r["candidate_ord"]: (r["hallucination_score"], r["explanation"]) for r in spark.read.parquet(fout).collect()}
    assert fs == fb


def test_encoder_and_dense_similarity(spark):
    def toy_encoder():  # nested, so it is shipped to the Python workers by value
        import zlib

        import numpy as np

        def enc(texts):
            out = np.zeros((len(texts), 16), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in (t or "").lower().split():
                    out[i, zlib.crc32(w.encode()) % 16] += 1.0
            return out
        return enc

    docs = FX.candidates(spark, SF001).select("candidate_ord", "marketing_text")
    emb = E.encode(docs, "candidate_ord", "marketing_text", toy_encoder)
    assert emb.count() == docs.count()
    vecs = FX.table(spark, SF001, "embeddings")
    rows = vecs.select(F.col("vec_id").alias("k"), F.col("embedding").alias("v"))
    refs = vecs.filter("label = 0").select(F.col("embedding").alias("r"))
    got = {r["k"]: r["best"] for r in E.max_dense_similarity(rows, "k", "v", refs, "r", "best", shard_rows=100, block_vectors=7).collect()}
    m = np.array([np.asarray(r["v"], float) for r in rows.orderBy("k").collect()])
    ref = np.array([np.asarray(r["r"], float) for r in refs.collect()])
    mn = m / np.linalg.norm(m, axis=1, keepdims=True)
    rn = ref / np.linalg.norm(ref, axis=1, keepdims=True)
    best = (mn @ rn.T).max(axis=1)
    keys = [r["k"] for r in rows.orderBy("k").collect()]
    for k, b in zip(keys, best):
        assert abs(got[k] - b) < 1e-9


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
