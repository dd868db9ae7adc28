"""M2-M4: requests to replies by a scorer that runs in tasks.

``score_requests`` deals the requests to parts by a hash of their key.  Each
task loads the scorer once, sends it batches bounded in rows and bytes, and
writes every finished batch to a journal in the shared folder before it goes
on.  Before its first call it reads what its part's journal already holds, so
neither a repeated task nor a second run calls the scorer twice for a finished
request.  A request that fails is a row with its error, and the others of its
batch are scored without it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.operators.common import ship_package

# Requests of a batch, and their bytes (one request may be longer).
BATCH_ROWS = 64
BATCH_BYTES = 1 << 20
# Requests per part: a part is one task with a journal folder of its own.
PART_ROWS = 20_000

Scorer = Callable[[list[str]], list[str | None]]
REPLY = pa.schema([("key", pa.string()), ("status", pa.string()), ("raw", pa.string()), ("error", pa.string())])


def batches_of(rows: list[tuple[str, str]], most_rows: int, most_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Runs of rows within both bounds."""
    here: list[tuple[str, str]] = []
    size = 0
    for key, text in rows:
        n = len(text.encode("utf-8", "surrogatepass"))
        if here and (len(here) >= most_rows or size + n > most_bytes):
            yield here
            here, size = [], 0
        here.append((key, text))
        size += n
    if here:
        yield here


def call(scorer: Scorer, batch: list[tuple[str, str]]) -> list[tuple[str, str, str | None, str | None]]:
    """(key, status, raw, error) of a batch; one that fails as a whole is
    asked for one by one, so that only the guilty request fails."""
    def answers(part: list[tuple[str, str]]) -> list[str | None]:
        got = list(scorer([t for _, t in part]))
        if len(got) != len(part):
            raise ValueError(f"{len(got)} replies to {len(part)} requests")
        return got

    try:
        return [(k, "no_reply" if r is None else "ok", r, None) for (k, _), r in zip(batch, answers(batch))]
    except Exception as whole:  # noqa: BLE001 - any failure of the scorer becomes a row
        if len(batch) == 1:
            return [(batch[0][0], "failed", None, f"{type(whole).__name__}: {whole}")]
        return [row for one in batch for row in call(scorer, [one])]


def _journal(folder: str, part: int):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    root = f"{root}/part={part}"
    store.create_dir(root, recursive=True)
    return store, root


def _finished(store, root: str, retry_failed: bool) -> set[str]:
    from pyarrow import fs
    from pyarrow import parquet

    done = set()
    for info in store.get_file_info(fs.FileSelector(root)):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                got = parquet.read_table(f, columns=["key", "status"])
            done |= {k for k, s in zip(got["key"].to_pylist(), got["status"].to_pylist())
                     if not (retry_failed and s == "failed")}
    return done


def _append(store, root: str, rows: list[tuple]) -> None:
    """A finished batch appears under its final name at once or not at all."""
    from pyarrow import parquet

    name = uuid.uuid4().hex
    table = pa.Table.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=REPLY)
    with store.open_output_stream(f"{root}/_{name}.tmp", compression=None) as f:
        parquet.write_table(table, f)
    store.move(f"{root}/_{name}.tmp", f"{root}/{name}.parquet")


def score_requests(requests: DataFrame, factory: Callable[[], Scorer], journal: str, key: str = "candidate_ord",
                   request: str = "request", batch_rows: int = BATCH_ROWS, batch_bytes: int = BATCH_BYTES,
                   part_rows: int = PART_ROWS, retry_failed: bool = False) -> DataFrame:
    """(key, status, raw, error) of every request: ``ok`` with the reply,
    ``no_reply`` where the scorer gave none, ``failed`` with the error.

    ``journal`` names a folder that all executors share; a run with the same
    requests and folder goes on where the last one ended.  Keys are unique (a
    repeated one is asked once); a NULL request is asked as an empty text.
    """
    spark = requests.sparkSession
    ship_package(spark)
    parts = _parts(spark, journal, lambda: max(1, -(-requests.count() // part_rows)))
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")
    rows = requests.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(request), F.lit("")).alias("text"),
                           place.alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        open_: dict[int, tuple] = {}
        calls = 0
        for b in batches:
            mine: dict[int, list[tuple[str, str]]] = {}
            for k, t, p in zip(*(c.to_pylist() for c in b.columns)):
                if p not in open_:
                    where = _journal(journal, p)
                    open_[p] = (*where, _finished(*where, retry_failed))
                if k not in open_[p][2]:
                    open_[p][2].add(k)
                    mine.setdefault(p, []).append((k, t))
            for p, some in mine.items():
                store, root, _ = open_[p]
                for batch in batches_of(some, batch_rows, batch_bytes):
                    scorer = scorer or factory()
                    _append(store, root, call(scorer, batch))
                    calls += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([calls], pa.int64())], names=["asked"])

    # one part per task
    rows.repartitionById(parts, F.col("part")).mapInArrow(run, "asked long").agg(F.sum("asked")).collect()
    return read_replies(spark, journal, requests, key)


def _parts(spark: SparkSession, journal: str, count: Callable[[], int]) -> int:
    """The number of parts of a journal, fixed by its first run."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{journal}/parts.json")
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if store.exists(path):
        return json.loads(spark.read.text(f"{journal}/parts.json").first()[0])["parts"]
    parts = count()
    out = store.create(path)
    out.write(json.dumps({"parts": parts}).encode())
    out.close()
    return parts


def read_replies(spark: SparkSession, journal: str, requests: DataFrame, key: str = "candidate_ord") -> DataFrame:
    """What the journal holds of the requests, one row per key: a reply before
    a failure, whoever wrote it."""
    held = spark.read.schema("key string, status string, raw string, error string").option(
        "pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(journal)
    order = F.when(F.col("status") == "failed", 1).otherwise(0)
    best = held.groupBy("key").agg(F.min(F.struct(order.alias("o"), "status", "raw", "error")).alias("r"))
    keys = requests.select(F.col(key)).distinct().withColumn("key", F.col(key).cast("string"))
    return keys.join(best, "key").select(key, "r.status", "r.raw", "r.error")
