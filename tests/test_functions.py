"""Boundary tests for the column functions (literal rows)."""

import math

import pytest
from pyspark.sql import functions as F

from proselens.functions import jsonx as J
from proselens.functions.scoring import gate_failure, normalize_coverage, overall_score, rejection_labels
from proselens.functions.text import display_name, py_split, py_strip
from proselens.operators.replies import factcheck_fields, judge_fields, parse_replies


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


# ---- tolerant JSON ---------------------------------------------------------------

CASES = [
    ('{"a": 1}', {"a": 1}),
    ('Sure! {"a": 1} hope it helps', {"a": 1}),
    ("{'a': 1}", {"a": 1}),                      # single quotes only
    ("{'a': \"x\"}", None),                      # mixed quotes: no rewrite, invalid
    ('{"a": 1, }', {"a": 1}),                    # comma before }
    ('{"a": 1,\n }', {"a": 1}),
    ('{"a": {"b": 2}', {"a": {"b": 2}}),         # one } missing
    ('{"a": 1', {"a": 1}),
    ("no json at all", None),
    ("", None),
    (None, None),
    ('{"a": 1} and {"b": 2}', None),             # two objects -> invalid
    ("[1, 2]", None),                            # not an object
    ("  {\"a\": [1, 2]}  ", {"a": [1, 2]}),
    ('{"a": "x"}}', None),
]


@pytest.mark.parametrize("raw,expected", CASES)
def test_tolerant_json(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "raw string")
    got = df.select(F.to_json(J.parse_json_tolerant("raw")).alias("j")).first()["j"]
    if expected is None:
        assert got is None
    else:
        import json
        assert json.loads(got) == expected


def test_missing_key_vs_json_null(spark):
    df = spark.createDataFrame([('{"a": null}',), ('{"b": 1}',), ('{"a": "1.5"}',)], "raw string")
    df = df.withColumn("v", J.parse_json_tolerant("raw"))
    rows = df.select(J.has_key("v", "a"), J.get_double("v", "a")).collect()
    assert [tuple(r) for r in rows] == [(True, None), (False, None), (True, 1.5)]


def test_judge_and_factcheck_defaults(spark):
    rows = [(1, None), (2, "garbage"), (3, "{}"), (4, '{"overall_score": 8, "relevance_score": "4.5"}'),
            (5, '{"overall_score": 7, "reason": null}')]
    p = parse_replies(spark.createDataFrame(rows, "k int, raw string"))
    j = {r["k"]: r for r in judge_fields(p).collect()}
    assert j[1]["judge_reason"] == "API error" and j[1]["judge_score"] is None
    assert j[2]["judge_reason"] == "Parse error"
    assert j[3]["judge_reason"] == "Parse error"          # empty object is a parse error
    assert j[4]["judge_score"] == 8.0 and j[4]["relevance_score"] == 4.5 and j[4]["judge_reason"] == ""
    assert j[5]["judge_reason"] is None                   # JSON null stays null
    f = {r["k"]: r for r in factcheck_fields(
        parse_replies(spark.createDataFrame([(1, None), (2, '{"has_hallucination": true}'),
                                             (3, '{"hallucination_score": null}')], "k int, raw string"))).collect()}
    assert f[1]["hallucination_score"] == 10.0 and f[1]["has_hallucination"] is False
    assert f[1]["explanation"] == "API error"
    assert f[2]["hallucination_score"] == 10.0 and f[2]["has_hallucination"] is True
    assert f[3]["hallucination_score"] is None            # explicit null is kept


def test_nan_and_junk_scores_fail(spark):
    from proselens.functions.scoring import gate_failure, safe_bool
    rows = [(float("nan"), True), (None, True), (7.5, True)]
    df = spark.createDataFrame(rows, "overall_score double, in_range boolean").withColumns({
        "judge_score": F.lit(9.0), "relevance_score": F.lit(4.0), "generalization_score": F.lit(4.0),
        "hallucination_score": F.lit(9.0), "semantic_attribute_alignment": F.lit(0.9)})
    got = [r[0] for r in df.select(gate_failure()).collect()]
    assert got[0] and got[1] and got[2] is None
    junk = spark.createDataFrame([("yes",), ("maybe",), (None,)], "b string")
    assert [r[0] for r in junk.select(safe_bool("b", False)).collect()] == [True, False, False]


# ---- coverage normalisation --------------------------------------------------------

# worked out by hand: covered features m = cov * n, then the piecewise map
@pytest.mark.parametrize("cov,n,expected", [
    (0.0, 0, 0.0), (0.5, 0, 0.0), (0.0, 5, 0.0),
    (0.25, 4, 0.375),      # m = 1
    (0.5, 4, 0.75),        # m = 2
    (0.5, 5, 0.825),       # m = 2.5
    (0.75, 4, 0.90),       # m = 3
    (0.7, 5, 0.925),       # m = 3.5
    (1.0, 4, 0.95),        # m = 4
    (1.0, 8, 1.0),         # m = 8 reaches the limit
    (1.0, 6, 0.975),       # m = 6
    (1.0, 20, 1.0),
    (0.3, 10, 0.90),       # m = 3
])
def test_normalize_coverage(spark, cov, n, expected):
    got = one(spark, [(cov, n)], "c double, n int", normalize_coverage("c", "n"))[0]
    assert math.isclose(got, expected, abs_tol=1e-9)


# ---- composite score -----------------------------------------------------------------

SCORE_SCHEMA = ("hallucination_score double, semantic_attribute_alignment double, judge_score double, "
                "semantic_feature_coverage_normalized double")


@pytest.mark.parametrize("row,expected", [
    ((6.99, 0.9, 9.0, 1.0), 3.0),
    ((None, 0.24, 9.0, 1.0), 4.0),        # missing hallucination counts 10
    ((7.0, 0.25, 8.0, 0.5), (0.5 * 0.8 + 0.25 * 0.25 + 0.1 * 0.5 + 0.15 * 0.7) * 10),
    ((None, None, None, None), 4.0),      # alignment defaults to 0
    ((10.0, 1.0, None, None), (0.25 + 0.15) * 10),
])
def test_overall_score(spark, row, expected):
    got = one(spark, [row], SCORE_SCHEMA, overall_score())[0]
    assert math.isclose(got, expected, abs_tol=1e-12)


GATE_SCHEMA = ("judge_score double, relevance_score double, generalization_score double, "
               "hallucination_score double, semantic_attribute_alignment double, in_range boolean, "
               "overall_score double")
PASS = (7.0, 3.5, 3.0, 8.0, 0.35, True, 7.0)


@pytest.mark.parametrize("idx,value,msg", [
    (0, 6.99, "Judge score too low (judge_score: 6.99 < 7.0)"),
    (1, 3.49, "Relevance too low (relevance: 3.49 < 3.5)"),
    (2, 2.99, "Generalization too low (generalization: 2.99 < 3.0)"),
    (3, 7.99, "Hallucination detected (hallucination: 7.99 < 8.0)"),
    (4, 0.34, "Poor attribute alignment (attribute_alignment: 0.34 < 0.35)"),
    (5, False, "Length out of range (in_range: False)"),
    (5, None, "Length out of range (in_range: False)"),
    (6, 6.999, "Overall score below threshold (7.00 < 7.0)"),
    (3, None, "Hallucination detected (hallucination: 0.00 < 8.0)"),   # gate default 0
])
def test_gates(spark, idx, value, msg):
    row = list(PASS)
    row[idx] = value
    assert one(spark, [tuple(row)], GATE_SCHEMA, gate_failure())[0] == msg


def test_gate_pass_at_limits(spark):
    assert one(spark, [PASS], GATE_SCHEMA, gate_failure())[0] is None


LABEL_SCHEMA = ("relevance_score double, generalization_score double, hallucination_score double, "
                "in_range boolean, semantic_feature_coverage_normalized double, "
                "semantic_attribute_alignment double, judge_reason string, char_len int")


@pytest.mark.parametrize("row,expected", [
    ((None, None, None, None, None, None, None, 500), ["low_overall_quality"]),
    ((3.0, 5.0, 7.9, True, 1.0, 1.0, "", 500), ["hallucination"]),
    ((3.0, 5.0, 8.0, True, 1.0, 1.0, "", 500), ["not_relevant"]),
    ((5.0, 2.9, 9.0, True, 1.0, 1.0, "Too NARROW", 500), ["too_specific"]),
    ((5.0, 2.9, 9.0, True, 1.0, 1.0, "non-specific text", 500), ["too_specific"]),  # substring test
    ((5.0, 2.9, 9.0, True, 1.0, 1.0, "vague", 500), ["too_generic"]),
    ((5.0, 2.9, 9.0, True, 1.0, 1.0, "meh", 500), ["poor_generalization"]),
    ((5.0, 5.0, 9.0, False, 1.0, 1.0, "", 449), ["too_short"]),
    ((5.0, 5.0, 9.0, False, 1.0, 1.0, "", 450), ["too_long"]),
    ((5.0, 5.0, 9.0, True, 0.29, 0.34, "unclear, unverified and biased", 500),
     ["unclear", "overclaim", "bias", "missing_features", "off_topic"]),
])
def test_rejection_labels(spark, row, expected):
    assert one(spark, [row], LABEL_SCHEMA, rejection_labels())[0] == expected


def test_python_whitespace_semantics(spark):
    rows = [(" \ta b c\n ",)]
    assert one(spark, rows, "t string", py_strip("t"))[0] == "a b c"
    assert one(spark, rows, "t string", py_split("t"))[0] == ["a", "b", "c"]
    assert one(spark, [("too_generic",)], "t string", display_name("t"))[0] == "Too Generic"
