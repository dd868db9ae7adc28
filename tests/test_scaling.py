"""What large tables need: references are not broadcast, only those that are
named are built, and frequent words propose no pairs."""

from pyspark.sql import functions as F

from conftest import SF001
from proselens.config import EvalConfig
from proselens.functions.text import nonblank_lines
from proselens.operators import products as P
from proselens.operators import similarity as S
from proselens.operators.dedup import candidate_pairs
from proselens.operators.encoders import HashedWords, TextVectors, UserModel, paired_vectors, vector_coverage
from proselens.operators.measures import features_of
from proselens.plans import catalog
from proselens.sources import fixtures as FX


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, ref string, text string")


def test_reference_texts_are_not_broadcast(spark):
    rows = texts(spark, (1, "a", "x y"), (2, "b", "x"), (3, None, "x"))
    refs = spark.createDataFrame([("a", "x y", ["x", "z"]), ("c", "x", [])], "ref string, t string, f array<string>")
    paired = S.paired_cosine(rows, "id", "text", refs, "ref", "t", "sim")
    covered = S.feature_coverage(rows, "id", "text", refs, "ref", "f", 0.1)
    vectors = TextVectors(UserModel(HashedWords), [(rows, "text"), (refs, "t")])
    dense = paired_vectors(rows, "id", "text", refs, "ref", "t", "sim", vectors)
    for df in (paired, covered, dense):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    for df in (paired, dense):
        assert {r[0]: round(r[1], 9) for r in df.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert {r[0]: r[1:] for r in covered.collect()} == {1: (2, 1, 0.5), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}
    vectors.release()


def test_only_named_products_are_built(spark):
    cands, prods = catalog._cand_products(spark, SF001)
    named = {r[0] for r in cands.select("product_id").distinct().collect()}
    built = {r[0] for r in prods.select("product_id").collect()}
    every = {r[0] for r in catalog.products(spark, SF001).select("product_id").collect()}
    assert built == named & every and built < every


def test_a_small_export_is_spread_over_tasks(spark):
    raw = FX.raw_products(spark, SF001).coalesce(1)
    out = P.load_products(raw, None)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_nonblank_lines(spark):
    some = ["", " ", "\n", "a", " a \n\n\t b  c\u2003\n", "\u00a0\na\rb\n \n", "a\n b", None]
    df = spark.createDataFrame([(t,) for t in some], "t string").select("t", nonblank_lines("t").alias("lines"))
    for t, lines in df.collect():
        assert lines == [x.strip() for x in (t or "").split("\n") if x.strip()]


def test_a_common_word_proposes_no_pairs(spark):
    rows = [(0, 0, 1, "common")] + [(i, i, 31, " ".join(["common", *[f"w{i}x{k}" for k in range(30)]])) for i in range(1, 50)]
    reps = spark.createDataFrame(rows, "ord long, gmin long, n long, text string")
    assert candidate_pairs(reps, [], 19, 20, EvalConfig(), 0.95).count() == 0
    # without a bound from term counts containment alone counts
    assert candidate_pairs(reps, [], 19, 20, EvalConfig()).count() == 49


def test_shared_features_are_sent_once(spark):
    rows = texts(spark, *[(i, f"p{i % 7}" if i % 11 else None, f"word{i % 5} shared{i % 3}") for i in range(200)])
    refs = spark.createDataFrame([(f"p{k}", ["shared1", "shared1", f"word{k}", " ", None, "shared2 more"]) for k in range(6)],
                                 "ref string, f array<string>")
    vectors = TextVectors(UserModel(HashedWords), [(rows, "text"), (features_of(refs, "f"), "feature")])
    results = [sorted(vector_coverage(rows, "id", "text", refs, "ref", "f", 0.45, vectors, group_texts=g).collect())
               for g in (1000, 3)]
    assert results[0] == results[1]
    by_id = {r[0]: r[1:] for r in results[0]}
    for i in range(200):
        k = i % 7
        hits = 0 if not i % 11 or k == 6 else 2 * (i % 3 == 1) + (k == i % 5) + (i % 3 == 2)
        n = 4 if i % 11 and k < 6 else 0
        assert by_id[i] == (n, hits, hits / n if n else 0.0)
    vectors.release()


def test_one_shared_word_of_many_proposes_no_pair_by_containment(spark):
    rows = [(i, i, 6, " ".join([f"rare{i % 3}", *[f"w{i}x{k}" for k in range(5)]])) for i in range(60)]
    rows += [(100, 100, 2, "p q"), (101, 101, 3, "p q r"), (102, 102, 1, "r"), (103, 103, 2, "r s")]
    reps = spark.createDataFrame(rows, "ord long, gmin long, n long, text string")
    pairs = candidate_pairs(reps, [], 19, 20, EvalConfig())
    assert sorted((r["i"], r["j"]) for r in pairs.collect()) == [(100, 101), (102, 103)]
