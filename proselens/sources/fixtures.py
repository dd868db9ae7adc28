"""Stand-in views over the driver tables (see FIXTURES.md, part B).

The domain inputs (product exports, generated texts, model replies) are not
public, so these views derive them deterministically from the test tables:
documents act as generated texts, labels as judge verdicts, part as the
product export and benchmark as descriptors and gold texts.  Every view is
a lazy projection of a scan, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselens.config import EvalConfig
from proselens.functions.scoring import normalize_coverage
from proselens.operators.common import with_row_index


_SCANS: dict[tuple[SparkSession, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a driver table.

    The scan DataFrame is reused within a session (DataFrames are immutable),
    so a query that reads a table in several branches resolves its schema
    once.
    """
    path = f"{sf_dir}/{name}.parquet"
    k = (spark, path)  # the session object itself, so a later session never reuses an entry
    if k not in _SCANS:
        _SCANS[k] = spark.read.parquet(path)
    return _SCANS[k]


def _d(x: float) -> Column:
    return F.lit(float(x))


def candidates(spark: SparkSession, sf_dir: str, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """One generated text per document, keyed like a pipeline candidate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    d = F.col("doc_id")
    it = (F.floor(d / 2.0).cast("bigint") % 4).cast("int")
    return docs.select(
        d.alias("candidate_ord"),
        F.floor(d / 8.0).cast("bigint").cast("string").alias("product_id"),
        F.when(d % 2 == 0, F.lit("model_a")).otherwise(F.lit("model_b")).alias("model"),
        it.alias("iteration"),
        F.lit("prompt").alias("prompt_family"),
        F.concat(F.lit("prompt_iter"), it.cast("string")).alias("prompt_name"),
        F.col("text").alias("marketing_text"),
        F.length("text").alias("char_len"),
        "lang", "source",
    )


def scored_candidates(spark: SparkSession, sf_dir: str, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """Candidates with judge / fact-check scores taken from ``labels``.

    Scores are NULL where a document has no label, which exercises the
    default rules of the scoring functions.
    """
    c = candidates(spark, sf_dir, cfg)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("candidate_ord"), "quality", "toxic")
    c = c.join(labels, "candidate_ord", "left")
    d = F.col("candidate_ord")
    q = F.col("quality").cast("double")
    t = F.col("toxic").cast("double")
    reason = (F.when(d % 7 == 0, F.lit("too narrow and specific"))
              .when(d % 7 == 1, F.lit("generic and vague"))
              .when(d % 7 == 2, F.lit("unclear wording"))
              .when(d % 7 == 3, F.lit("unsupported claim"))
              .when(d % 7 == 4, F.lit("shows bias"))
              .when(d % 7 == 5, F.lit("Solid text")))
    cov = (d % 11).cast("double") / _d(10.0)
    nfeat = (d % 7).cast("int")
    # first row of each identical text per iteration; partitioning by a
    # SHA-256 of the text lets the text itself be pruned before the shuffle
    first_of_text = Window.partitionBy("iteration", F.sha2(F.col("marketing_text"), 256))
    return c.select(
        "candidate_ord", "product_id", "model", "iteration", "prompt_family", "prompt_name",
        "marketing_text", "char_len", "lang", "source",
        F.col("char_len").between(cfg.min_chars, cfg.max_chars).alias("in_range"),
        ((d % 17).cast("double") / _d(16.0)).alias("sbert"),
        (_d(6.0) + _d(2.5) * q + (d % 10).cast("double") / _d(10.0)).alias("judge_score"),
        (_d(3.0) + q + (d % 5).cast("double") / _d(10.0)).alias("relevance_score"),
        (_d(2.5) + q + (d % 3).cast("double") / _d(10.0)).alias("generalization_score"),
        reason.alias("judge_reason"),
        F.lit(None).cast("double").alias("judge_score_secondary"),
        F.lit(None).cast("double").alias("relevance_score_secondary"),
        F.lit(None).cast("double").alias("generalization_score_secondary"),
        (F.col("toxic") == 1).alias("has_hallucination"),
        (_d(9.5) - _d(3.0) * t - (d % 4).cast("double") / _d(10.0)).alias("hallucination_score"),
        ((d % 21).cast("double") / _d(20.0)).alias("semantic_attribute_alignment"),
        cov.alias("semantic_feature_coverage"),
        nfeat.alias("num_features"),
        normalize_coverage(cov, nfeat).alias("semantic_feature_coverage_normalized"),
        (d == F.min(d).over(first_of_text)).alias("is_unique"),
    )


# The reply variants cycled through by (doc_id + kind) % 8.
REPLY_PREFIX = "Here is my answer:\n"
REPLY_SUFFIX = "\nLet me know if you need more."
REPLY_NO_JSON = "I cannot produce JSON for this product."
KINDS = ["generation", "judge", "factcheck"]


def _reply_bodies(d: Column) -> dict[str, Column]:
    s = lambda x: x.cast("string")
    gen = F.concat(F.lit('{"header": "Header '), s(d), F.lit('", "subheader": "'), F.col("lang"),
                   F.lit(" "), F.col("source"), F.lit('", "marketing_text": "Text '), s(d), F.lit('"}'))
    judge = F.concat(
        F.lit('{"overall_score": '), s(F.floor((d % 40) / 10.0).cast("bigint") + 6),
        F.lit("."), s(d % 10),
        F.lit(', "relevance_score": '), s(d % 5 + 1),
        F.lit(', "generalization_score": "'), s(d % 4 + 2), F.lit("."), s(d % 3),
        F.lit('", "reason": "'), F.when(d % 3 == 0, F.lit("too generic")).when(d % 3 == 1, F.lit("unclear claim"))
        .otherwise(F.lit("fine")), F.lit('"}'))
    fact = F.concat(
        F.lit('{"has_hallucination": '), F.when(d % 5 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "hallucination_score": '), s(d % 10 + 1),
        F.lit(', "hallucinated_claims": [{"claim": "c'), s(d), F.lit('", "issue": "made up", "severity": "low"}]'),
        F.lit(', "explanation": "checked"}'))
    return {"generation": gen, "judge": judge, "factcheck": fact}


def _variant(body_: Column, v: Column) -> Column:
    from proselens.functions.jsonx import let
    return let(body_, lambda body: _variant_of(body, v))


def _variant_of(body: Column, v: Column) -> Column:
    cut = F.substring(body, F.lit(1), F.length(body) - 1)
    return (F.when(v == 0, body)
            .when(v == 1, F.concat(F.lit(REPLY_PREFIX), body))
            .when(v == 2, F.concat(body, F.lit(REPLY_SUFFIX)))
            .when(v == 3, F.replace(body, F.lit('"'), F.lit("'")))
            .when(v == 4, F.concat(cut, F.lit(", }")))
            .when(v == 5, cut)
            .when(v == 6, F.lit(REPLY_NO_JSON)))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies: three kinds per candidate, eight repair variants,
    plus rows with a missing key, an explicit null and an empty object."""
    c = candidates(spark, sf_dir)
    d = F.col("candidate_ord")
    bodies = _reply_bodies(d)
    out = None
    for k, kind in enumerate(KINDS):
        v = (d + k) % 8
        raw = _variant(F.col("_body"), v)
        if kind == "generation":
            raw = (F.when(d % 50 == 4, F.lit('{"header": "H", "subheader": null}'))
                   .when(d % 50 == 5, F.lit('{"header": "H", "subheader": "S", "marketing_text": null}'))
                   .otherwise(raw))
        elif kind == "judge":
            raw = (F.when(d % 50 == 1, F.lit('{"overall_score": null, "relevance_score": 4}'))
                   .when(d % 50 == 2, F.lit("{}"))
                   .otherwise(raw))
        else:
            raw = F.when(d % 50 == 3, F.lit('{"has_hallucination": false}')).otherwise(raw)
        part = c.withColumn("_body", bodies[kind]).select(
            "candidate_ord", "product_id", "model", "iteration", "prompt_name",
            F.lit(kind).alias("kind"), raw.alias("raw"))
        out = part if out is None else out.unionByName(part)
    return out


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product export with spreadsheet-style column names, from ``part``."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("<ID>"),
        F.col("p_brand").alias("Product brand"),
        F.col("p_type").alias("Type"),
        F.col("p_name").alias("Product designation"),
        F.concat(F.col("p_name"), F.lit("\n\n "), F.col("p_type"), F.lit(" ")).alias("Characteristics"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("Application purposes"),
        F.col("p_size").cast("string").alias("Size"),
        F.format_string("%.2f", F.col("p_retailprice")).alias("Price"),
        F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("nan")).when(k % 4 == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("  made by "), F.col("p_brand"), F.lit(" "))).alias("Note"),
    )


# The four product types that get descriptors (two are left out
# so that the brand fallback is reached).
DESCRIPTOR_TYPES = ["ECONOMY", "Medium ", " large", "standard"]


def raw_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor rows (asset, title, insight, benefit, function) from ``benchmark``."""
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    typ = F.element_at(F.array(*[F.lit(x) for x in DESCRIPTOR_TYPES]),
                       (F.floor(i / 3.0).cast("bigint") % 4 + 1).cast("int"))
    asset = F.when(i % 3 == 0, typ).otherwise(F.concat(F.lit("Brand#"), (i % 12 + 1).cast("string")))
    t = F.col("text")
    return b.select(
        i.alias("ord"),
        asset.alias("AssetName"),
        F.lit(None).cast("string").alias("AssetName.1"),
        F.substring(t, 1, 30).alias("Title"),
        F.when(i % 5 == 0, F.lit(None).cast("string")).otherwise(F.substring(t, 31, 40)).alias("Insight"),
        # Benefit holds what a neighbour that is NULL leaves out, so that the
        # cells of every row are the whole text, however long
        F.substring(t, F.when(i % 5 == 0, 31).otherwise(71),
                    F.when(i % 4 == 1, F.length(t)).otherwise(F.when(i % 5 == 0, 80).otherwise(40))).alias("Benefit"),
        F.when(i % 4 == 1, F.lit(None).cast("string")).otherwise(F.substring(t, F.lit(111), F.length(t))).alias("Function"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold texts: every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("gold_id"),
                                                    F.col("text").alias("marketing_text"))


def with_gold(cands: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair every candidate with one of all gold rows: the one whose place by
    ``gold_id`` is the candidate's number modulo their count."""
    ids = gold(spark, sf_dir).select("gold_id")
    n = ids.count()
    place = with_row_index(ids.repartitionByRange("gold_id").sortWithinPartitions("gold_id"), "_place")
    return cands.withColumn("_place", F.col("candidate_ord") % n).join(place, "_place", "left").drop("_place")


def raw_series_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    return b.select(
        F.concat(F.lit(" Brand#"), (i % 7 + 1).cast("string")).alias("series"),
        F.when(i % 6 == 5, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.col("text"))).alias("marketing_text"),
        i.alias("ord"),
    )


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side: English texts as one dataset, the rest as the other."""
    s = scored_candidates(spark, sf_dir)
    return s.withColumn("dataset", F.when(F.col("lang") == "en", F.lit("with_reference"))
                        .otherwise(F.lit("without_reference")))


def text_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose generation kind carries the document text as
    ``marketing_text`` (JSON-encoded; some wrapped in prose, some missing);
    judge and fact-check replies as in ``replies``."""
    c = candidates(spark, sf_dir)
    d = F.col("candidate_ord")
    body = F.to_json(F.struct(F.concat(F.lit("Header "), d.cast("string")).alias("header"),
                              F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("subheader"),
                              F.col("marketing_text")))
    v = d % 5
    b = F.col("_body")
    raw = (F.when(v == 1, F.concat(F.lit(REPLY_PREFIX), b)).when(v == 2, F.concat(b, F.lit(REPLY_SUFFIX)))
           .when(v == 4, F.lit(None).cast("string")).otherwise(b))
    gen = c.withColumn("_body", body).select("candidate_ord", "product_id", "model", "iteration", "prompt_name",
                   F.lit("generation").alias("kind"), raw.alias("raw"))
    return gen.unionByName(replies(spark, sf_dir).filter(F.col("kind") != "generation"))
