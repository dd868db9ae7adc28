"""Catalogue operators on literal exports."""

from proselens.functions.jsonx import parse_list_text
from proselens.operators.products import descriptor_blocks, enrich, lower_columns, normalize_products, rename_present
from proselens.plans.reports import union_iterations


def test_generated_ids_and_features(spark):
    rows = [("A", "Brand X", "line one\n  line two \n\n", None, " 3 kg ", "nan", "None"),
            ("B", None, None, "use 1", "", "x", None)]
    df = spark.createDataFrame(rows, "`Product designation` string, `Product brand` string, "
                                     "`Characteristics` string, `Application purposes` string, "
                                     "Weight string, Colour string, Extra string").repartition(2)
    out = {r["name"]: r for r in normalize_products(df).collect()}
    assert sorted(r["product_id"] for r in out.values()) == ["prod_0001", "prod_0002"]
    assert out["A"]["features"] == ["line one", "line two"]
    assert out["A"]["technical_data"] == {"Weight": "3 kg"}
    assert out["A"]["specs"] == "Weight: 3 kg"
    assert out["A"]["series"] == "Brand X"
    assert out["B"]["features"] == ["use 1"]
    assert out["B"]["technical_data"] == {"Colour": "x"}


def test_columns_that_look_derived_are_kept(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", "d")], "`<ID>` int, `_Weight` string, `Series` string, Volt string, "
                                                          "brand string")
    assert normalize_products(df).first()["technical_data"] == {"_Weight": "a", "Series": "b", "Volt": "c"}


def test_ids_follow_the_file_order(spark, tmpdir_path):
    from proselens.sources.readers import read_descriptors, read_product_export

    rows = [(f"name {i}", i) for i in range(500)]
    path = tmpdir_path + "/export"
    spark.createDataFrame(rows, "`Product designation` string, Size int").orderBy("Size").coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = normalize_products(read_product_export(spark, path)).collect()
        desc = read_descriptors(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["product_id"]: r["name"] for r in got} == {f"prod_{i + 1:04d}": f"name {i}" for i in range(500)}
    assert {r["ord"]: r["Size"] for r in desc} == {i: i for i in range(500)}


def test_enrichment_priority(spark):
    prods = spark.createDataFrame([(1, "Brand#1", " TYPE_A "), (2, "BRAND#2", "other"), (3, None, None)],
                                  "`<ID>` int, `Product brand` string, `Type` string")
    desc = spark.createDataFrame([(0, "type_a", "t1", None, "b1", "f1"), (1, "Type_A", "t2", "i2", "b2", "f2"),
                                  (2, "brand#2", "t3", "i3", "b3", None), (3, None, "x", "x", "x", "x")],
                                 "ord long, AssetName string, Title string, Insight string, Benefit string, "
                                 "Function string")
    blocks = {r["asset_name"]: r["ibf_block"] for r in descriptor_blocks(desc).collect()}
    assert set(blocks) == {"type_a", "brand#2"}
    assert blocks["type_a"].startswith("\nIBF 1:\n  Title: t1\n  Insight: \n") and "IBF 2:\n  Title: t2" in blocks["type_a"]
    e = enrich(rename_present(lower_columns(prods), {"<id>": "product_id", "product brand": "brand"}),
               descriptor_blocks(desc))
    got = {r["product_id"]: r["ibf_match"] for r in e.collect()}
    assert got == {1: "type", 2: "brand", 3: "none"}


def test_list_text_and_union(spark):
    df = spark.createDataFrame([("['a', 'b']",), ("plain",), ("",), (None,), ("[\"it's\", 'b']",), ("['x\\'y', 3]",),
                                ("['a'",), ("[]",), ("[a b]",), ("('p, q',)",)], "t string")
    assert [r[0] for r in df.select(parse_list_text("t")).collect()] == [
        ["a", "b"], ["plain"], [], [], ["it's", "b"], ["x'y", "3"], ["['a'"], [], ["[a b]"], ["p, q"]]
    a = spark.createDataFrame([(0, 1.0)], "iteration int, x double")
    b = spark.createDataFrame([(1, "y")], "iteration int, z string")
    u = union_iterations([a, None, b])
    assert u.count() == 2 and set(u.columns) == {"iteration", "x", "z"}
