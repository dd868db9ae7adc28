"""Shared helpers: the folder for cut lineage, skew-safe joins, shipping code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot from this share of all rows on, so fewer than HOT_KEYS keys
# are hot, whatever the size of the table: that is the proven bound of the
# broadcast in ``join_on_hot_key``.
HOT_KEYS = 1000
# Rows of an Arrow batch at most: rows here are whole texts, so this bounds
# what a Python worker holds at a time.  It changes no result.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``.  Where it is unset, a local session
    (tests) gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="proselens-local-"))
    return sc.getCheckpointDir().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, and keep
    their batches within BATCH_ROWS."""
    sc = spark.sparkContext
    rows = int(spark.conf.get(_BATCH_CONF))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    if getattr(sc, "_proselens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="proselens-code-"), "proselens_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._proselens_shipped = True


class Scratch:
    """Tables that one operator call writes under the shared folder.

    Writing a table cuts the lineage: what has been written survives the loss
    of any executor.  ``drop`` deletes a table that no later step reads; those
    that the returned plan reads stay for the caller.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        w = df.write.mode("overwrite")
        if compression:
            w = w.option("compression", compression)
        w.parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(conf).delete(p, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of an input, whatever they are
    called, never meet the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_on_hot_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
                    n: str = "_n", total: int = 0) -> DataFrame:
    """Join a skewed left side with a right side that is unique on ``key`` and
    carries in ``n`` how many left rows each key has.

    The keys with at least ``total / HOT_KEYS`` rows, fewer than HOT_KEYS of
    them, are broadcast and never shuffle the left side; all other keys take
    the shuffled join, where no key holds more than that share.
    """
    limit = max(2, total // HOT_KEYS)
    hot = right.filter(F.col(n) >= limit)
    cold = right.filter(F.col(n) < limit)
    names = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    tagged = left.join(names, key, "left")
    a = tagged.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key, "inner")
    b = tagged.filter(F.col("_hot").isNull()).drop("_hot").join(cold, key, how)
    return a.unionByName(b)
