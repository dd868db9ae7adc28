"""Product catalogue: column cleaning, features, technical data, enrichment.

Column names are matched case-insensitively; NULL keys never match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselens.functions.text import nonblank_lines, py_strip
from proselens.operators.common import BLOCK_COL, FILE_COL, broadcast_if_small, find_col, spread_by, with_row_index

# Columns of a product export that are not technical data.
EXCLUDED_COLUMNS = [
    "<ID>", "<n>", "Product brand", "Type", "Sortiment",
    "Product designation", "Reference for product designation",
    "Image", "<0 Primary Image EPS.|Node|.URL of converted asset>",
    "Application purposes", "Characteristics", "Scope of delivery",
]
# Renames applied to the product export and the descriptors.
PRODUCT_RENAMES = {"<id>": "product_id", "product brand": "brand", "type": "type"}
DESCRIPTOR_RENAMES = {"AssetName": "asset_name", "AssetName.1": "asset_name_alt", "Title": "IBF_Title",
                      "Insight": "IBF_Insight", "Benefit": "IBF_Benefit", "Function": "IBF_Feature"}
# Cell texts that count as empty.
BLANK_VALUES = ["", "nan", "none"]
# Columns that the steps themselves derive, by their exact names.
_DERIVED = {"product_id", "brand", "type", "ibf_data", "name", "series", "features",
            "technical_data", "specs", FILE_COL, BLOCK_COL}


def lower_columns(df: DataFrame) -> DataFrame:
    """Every column name lower-cased and stripped."""
    return df.toDF(*[c.lower().strip() for c in df.columns])


def rename_present(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename only the columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns and k != v})


def clean_key(c) -> "F.Column":
    """Join key as text, lower-cased and stripped; NULL stays NULL."""
    return F.lower(py_strip(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")))


def _text_or_empty(df: DataFrame, name: str):
    c = find_col(df, name)
    return F.col(f"`{c}`").cast("string") if c else F.lit("")


def merge_features(df: DataFrame) -> "F.Column":
    """Lines of Characteristics, then of Application purposes; stripped, non-empty."""
    parts = []
    for name in ("Characteristics", "Application purposes"):
        c = find_col(df, name)
        if c:
            parts.append(nonblank_lines(F.col(f"`{c}`").cast("string")))
    if not parts:
        return F.array().cast("array<string>")
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def tech_columns(df: DataFrame) -> list[str]:
    excluded = {e.lower().strip() for e in EXCLUDED_COLUMNS}
    out = []
    for f in df.schema.fields:
        if f.name.lower().strip() in excluded or f.name in _DERIVED:
            continue
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            continue  # list-like cells are not technical data
        out.append(f.name)
    return out


def tech_specs(df: DataFrame, columns: list[str] | None = None) -> "F.Column":
    """MAP<STRING,STRING> of the non-blank remaining columns, in column order."""
    cols = tech_columns(df) if columns is None else columns
    if not cols:
        return F.create_map().cast("map<string,string>")
    keys = F.array(*[F.lit(c) for c in cols])
    vals = F.array(*[py_strip(F.col(f"`{c}`").cast("string")) for c in cols])
    m = F.map_from_arrays(keys, vals)
    return F.map_filter(m, lambda k, v: v.isNotNull() & ~F.lower(v).isin(*BLANK_VALUES))


def specs_text(m) -> "F.Column":
    """``"k: v, k: v"`` in map order; empty map -> ''."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")


def normalize_products(df: DataFrame) -> DataFrame:
    """H2 (P4-P9): standard product rows from a raw export.

    ``product_id`` is the id column as text, or ``prod_0001...`` in file
    order when the export has none.
    """
    idc = find_col(df, "<ID>") or find_col(df, "product_id")
    tcols = tech_columns(df)
    if idc is None:
        df = with_row_index(df, "__row")
        pid = F.format_string("prod_%04d", F.col("__row") + 1)
    else:
        pid = F.col(f"`{idc}`").cast("string")
    brand = find_col(df, "Product brand") or find_col(df, "brand")
    sortiment = find_col(df, "Sortiment")
    series = F.col(f"`{brand}`").cast("string") if brand else (
        F.col(f"`{sortiment}`").cast("string") if sortiment else F.lit(""))
    tech = tech_specs(df, tcols)
    out = df.select(
        pid.alias("product_id"),
        _text_or_empty(df, "Product designation").alias("name"),
        series.alias("series"),
        merge_features(df).alias("features"),
        tech.alias("technical_data"),
        *([F.col("ibf_data")] if "ibf_data" in df.columns else []),
    )
    out = out.withColumn("specs", specs_text("technical_data"))
    cols = ["product_id", "name", "series", "features", "technical_data", "specs"]
    return out.select(*cols, *(["ibf_data"] if "ibf_data" in out.columns else []))


def descriptor_blocks(desc: DataFrame, ord_col: str = "ord") -> DataFrame:
    """A1: one numbered text block per asset, descriptor rows in file order.

    Block per row i (1-based): ``"\\nIBF i:\\n  Title: ..\\n  Insight: ..\\n
    Benefit: ..\\n  Feature: ..\\n"``; a missing column or NULL cell prints
    blank.  The list per asset is bounded by the descriptors of one asset.
    """
    d = rename_present(desc, DESCRIPTOR_RENAMES)
    fields = []
    for c in ("IBF_Title", "IBF_Insight", "IBF_Benefit", "IBF_Feature"):
        v = F.coalesce(F.col(c).cast("string"), F.lit("")) if c in d.columns else F.lit("")
        fields.append(v.alias(c))
    d = d.select(clean_key("asset_name").alias("asset_name"), F.col(ord_col).alias("ord"), *fields)
    d = d.filter(F.col("asset_name").isNotNull())
    g = d.groupBy("asset_name").agg(F.array_sort(F.collect_list(
        F.struct("ord", "IBF_Title", "IBF_Insight", "IBF_Benefit", "IBF_Feature"))).alias("rows"))
    block = F.transform("rows", lambda r, i: F.concat(
        F.lit("\nIBF "), (i + 1).cast("string"), F.lit(":\n  Title: "), r["IBF_Title"],
        F.lit("\n  Insight: "), r["IBF_Insight"], F.lit("\n  Benefit: "), r["IBF_Benefit"],
        F.lit("\n  Feature: "), r["IBF_Feature"], F.lit("\n")))
    return g.select("asset_name", F.array_join(block, "").alias("ibf_block"))


def enrich(products: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Descriptor block by product type, else by brand, else ''.

    ``products`` carries raw ``type`` / ``brand`` columns (any case).  The
    block table has one row per asset, so the joins cannot fan out; it is
    broadcast only after a row-count check.
    """
    tcol = find_col(products, "type")
    bcol = find_col(products, "brand") or find_col(products, "product brand")
    p = products.withColumn("_type_key", clean_key(F.col(f"`{tcol}`")) if tcol else F.lit(None).cast("string")) \
                .withColumn("_brand_key", clean_key(F.col(f"`{bcol}`")) if bcol else F.lit(None).cast("string"))
    if blocks is None:
        return p.withColumn("ibf_data", F.lit("")).withColumn("ibf_match", F.lit("none")).drop("_type_key", "_brand_key")
    b = broadcast_if_small(blocks)
    bt = b.select(F.col("asset_name").alias("_type_key"), F.col("ibf_block").alias("_by_type"))
    bb = b.select(F.col("asset_name").alias("_brand_key"), F.col("ibf_block").alias("_by_brand"))
    out = p.join(bt, "_type_key", "left").join(bb, "_brand_key", "left")
    return (out.withColumn("ibf_data", F.coalesce("_by_type", "_by_brand", F.lit("")))
            .withColumn("ibf_match", F.when(F.col("_by_type").isNotNull(), F.lit("type"))
                        .when(F.col("_by_brand").isNotNull(), F.lit("brand")).otherwise(F.lit("none")))
            .drop("_type_key", "_brand_key", "_by_type", "_by_brand"))


def load_products(raw: DataFrame, descriptors: DataFrame | None, ord_col: str = "ord") -> DataFrame:
    """H1: clean column names, enrich from descriptors, normalise."""
    p = rename_present(lower_columns(raw), PRODUCT_RENAMES)
    # an export is a small file with much to build per row; without ids its
    # rows must stay in file order
    if find_col(p, "product_id"):
        p = spread_by(p, *[f"`{c}`" for c in p.columns])
    blocks = descriptor_blocks(descriptors, ord_col) if descriptors is not None else None
    p = enrich(p, blocks).drop("ibf_match")
    return normalize_products(p)


def match_rate(enriched: DataFrame) -> DataFrame:
    """Products with a non-empty descriptor block, of all products."""
    return enriched.agg(
        F.count_if(F.col("ibf_data") != "").cast("bigint").alias("matched"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    ).withColumn("match_rate", F.round(F.try_divide(F.col("matched").cast("double"), F.col("total")), 6))
