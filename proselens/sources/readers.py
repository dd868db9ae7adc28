"""Domain readers: product exports, descriptor tables, gold texts, results.

Inputs are columnar files (parquet by default; csv and json are accepted),
read lazily so that column pruning and filter pushdown reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.functions.text import py_strip
from proselens.operators.common import with_file_position, with_row_index


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True)
    return reader.format(fmt).load(path)


def read_product_export(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The raw product export (wide, dynamic attribute columns), its rows
    tagged with their file position, from which missing ids are numbered."""
    return with_file_position(read_table(spark, path, fmt))


def read_descriptors(spark: SparkSession, path: str | None, fmt: str = "parquet") -> DataFrame | None:
    """The optional descriptor table with ``ord``, its row number in file
    order; ``None`` when no path is given."""
    if not path:
        return None
    return with_row_index(with_file_position(read_table(spark, path, fmt)), "ord")


def read_series_gold(spark: SparkSession, path: str | None, fmt: str = "parquet") -> DataFrame | None:
    """The (series, marketing_text) table; the last row in file order wins."""
    return series_gold(read_descriptors(spark, path, fmt))


def load_counts(**tables: DataFrame | None) -> DataFrame:
    """Rows of each loaded table, (name, rows); a missing table counts 0."""
    out = None
    for name, df in tables.items():
        rows = F.count(F.lit(1)).cast("bigint").alias("rows")
        if df is None:
            continue
        part = df.agg(rows).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    missing = [(n, 0) for n, df in tables.items() if df is None]
    if out is None or not missing:
        return out
    return out.unionByName(out.sparkSession.createDataFrame(missing, "name string, rows long"))


def gold_texts(df: DataFrame | None) -> DataFrame | None:
    """Gold texts need a ``marketing_text`` column; rows without text drop."""
    if df is None or "marketing_text" not in df.columns:
        return None
    return df.filter(F.col("marketing_text").isNotNull())


def series_gold(df: DataFrame | None, ord_col: str = "ord") -> DataFrame | None:
    """Series-level gold.  Trimmed; empty texts skipped; the last row of
    a series (largest ``ord``, the scan order where there is none) wins."""
    if df is None or not {"series", "marketing_text"}.issubset(set(df.columns)):
        return None
    if ord_col not in df.columns:
        df = with_row_index(df, ord_col)
    t = df.select(py_strip(F.col("series").cast("string")).alias("series"),
                  py_strip(F.col("marketing_text").cast("string")).alias("marketing_text"),
                  F.col(ord_col).alias("ord"))
    t = t.filter(F.col("marketing_text").isNotNull() & (F.col("marketing_text") != ""))
    return t.groupBy("series").agg(F.max_by("marketing_text", "ord").alias("marketing_text"))


def read_results(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Result tables of several runs, tagged with ``dataset`` and unioned."""
    out = None
    for name, p in paths.items():
        d = read_table(spark, p, fmt).withColumn("dataset", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_standard_products(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Already standardised products.  A ``features`` column stored as
    list text is parsed once here (X6), so later steps always see an array."""
    from proselens.functions.jsonx import parse_list_text

    df = read_table(spark, path, fmt)
    if "features" in df.columns and dict(df.dtypes)["features"] == "string":
        df = df.withColumn("features", parse_list_text("features"))
    return df
