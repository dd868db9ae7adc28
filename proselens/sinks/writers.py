"""K1-K7: sinks.  Columnar files partitioned by ``iteration`` so that later
reads prune partitions; booleans can be exported as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.operators.report import bool_export


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1: the full result table, partitioned by iteration; whatever the
    folder held before goes, iterations that ``df`` lacks included."""
    (df.write.mode(mode).option("partitionOverwriteMode", "static")
     .partitionBy("iteration").format(fmt).save(path))


def write_aggregate(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K2: the aggregate table (one row per iteration, model, prompt)."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_iteration_checkpoint(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K3: replace only the partitions of the iterations present in ``df``
    (dynamic partition overwrite), so a re-run of one iteration keeps the
    others."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("iteration").format(fmt).save(path))


def write_summary_json(summary: DataFrame, path: str) -> None:
    """K4: the one-row quality summary as JSON with a timestamp."""
    (summary.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
     .coalesce(1).write.mode("overwrite").json(path))


def append_history(history: DataFrame, path: str) -> None:
    """K6: add the per-prompt improvement report of an iteration; a re-run of
    the iteration replaces its rows."""
    (history.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("iteration").json(path))


def write_text_booleans(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """K7: export with booleans as 'TRUE' / 'FALSE'."""
    out = bool_export(df)
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
