"""Small shared helpers: size-checked broadcast, row order, column lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only within these bounds (both checked).
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only after checking the number of rows and their bytes.

    The check reads at most ``max_rows + 1`` rows.  Larger sides are left to
    the planner (sort-merge join, AQE may still switch at run time).
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and total <= max_bytes else df


def find_col(df: DataFrame, name: str) -> str | None:
    """Column whose lower-cased, stripped name equals ``name``."""
    want = name.lower().strip()
    for c in df.columns:
        if c.lower().strip() == want:
            return c
    return None


# Columns that carry the file position of a row from a reader.
FILE_COL, BLOCK_COL = "__source_file", "__source_block"


def with_file_position(df: DataFrame) -> DataFrame:
    """Tag the rows of a file scan with their file and its block."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE_COL),
                     F.col("_metadata.file_block_start").alias(BLOCK_COL))


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Consecutive 0-based index in file order (of rows tagged by
    ``with_file_position``; else in scan order), without a single-task window.

    The tagged rows are written once, so both reads below see the same
    numbers; one row per file block gives the offsets.
    """
    keys = [c for c in (FILE_COL, BLOCK_COL) if c in df.columns]
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    if not keys:
        tagged = tagged.withColumn(FILE_COL, F.lit("")).withColumn(BLOCK_COL, F.shiftright("_mid", 33))
    tagged = materialize(tagged, "row-index")
    blocks = tagged.groupBy(FILE_COL, BLOCK_COL).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    before = F.sum("_n").over(Window.orderBy(FILE_COL, BLOCK_COL).rowsBetween(Window.unboundedPreceding, -1))
    # one row per file block: bounded by the number of splits
    offsets = F.broadcast(blocks.withColumn("_off", F.coalesce(before, F.lit(0))).drop("_n"))
    out = tagged.join(offsets, [FILE_COL, BLOCK_COL])
    return out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first")).drop(
        "_mid", "_first", "_off", FILE_COL, BLOCK_COL)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint
    folder (``spark.checkpoint.dir``) and reading it back.

    The plan runs once, and the files survive the loss of any executor.  The
    returned frame knows its folder: ``release`` deletes it when no later
    step reads it.
    """
    import uuid

    from proselens.session import checkpoint_dir

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/proselens-{label}-{uuid.uuid4().hex}"
    # what the write has shuffled goes with it: nothing else reads that
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the folders behind frames returned by ``materialize``."""
    for df in frames:
        path = df.__dict__.pop("stage_path", None)
        if path is not None:
            sc = df.sparkSession.sparkContext
            hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by ``keys`` into ``spark.sql.shuffle.partitions``
    buckets, a count that AQE leaves alone: per-text work outweighs its bytes.

    Used before tokenising texts: the shuffle moves each text once (cheaper
    than moving its exploded tokens), spreads the per-text CPU work over all
    tasks even when the scan has few splits, and leaves the data clustered
    by the text key, so per-text aggregations that follow (token counts,
    norms) need no further exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def referenced(ref: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The rows of ``ref`` that some row points to by ``key``: what nobody
    names is left out before anything wide is built for it."""
    return ref.join(rows.select(key).distinct(), key, "left_semi")


def by_key(ref: DataFrame) -> DataFrame:
    """The side of an equi-join that must never be broadcast: its files, or
    the files it is built from, are far smaller than its rows in memory (long
    texts that repeat, sparse vectors), so the planner would underrate it."""
    return ref.hint("merge")


def ship_package(spark) -> None:
    """Send this package to the Python workers, once per application: code
    that runs in tasks is found there by name."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_proselens_package", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # the archive is handed to Spark, which serves it to every executor
    target = os.path.join(tempfile.mkdtemp(prefix="proselens-package-"), "proselens_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._proselens_package = True
