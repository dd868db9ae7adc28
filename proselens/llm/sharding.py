"""Byte-balanced sharding of indivisible groups (operator 2).

Karmarkar-Karp differencing for ``shards`` ways.  Every group begins as a
partial partition that has its size in one slot and nothing in the others.
The two partial partitions with the largest spread are combined again and
again, the largest slot of one with the smallest of the other, until one is
left.  Differencing runs in levels: each task combines the groups that a hash
dealt to it, then further tasks combine up to ``fan_in`` partial partitions
(vectors of ``shards`` sums) each, until at most ``fan_in`` are left, which
the driver combines.  So what meets in one place never grows with the data.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proselens.llm.common import Scratch, join_on_hot_key, pick, ship
from proselens.operators.common import broadcast_if_small

# Groups that one differencing task combines: bounds its memory.
GROUPS_PER_TASK = 50_000
# Partial partitions that one task, or the driver at the end, combines.
FAN_IN = 1000


def difference(parts: list[np.ndarray]) -> np.ndarray:
    """Combine partial partitions by largest spread, oppositely ordered.

    ``parts``: one vector of slot sums each.  Returns, per part, the slot of
    the result that each of its slots became.
    """
    n, ways = len(parts), len(parts[0])
    # vectors are kept in descending order; ``order`` maps places back to slots
    nodes = [np.sort(p)[::-1].astype(np.float64) for p in parts]
    order = [np.argsort(-np.asarray(p, dtype=np.float64), kind="stable") for p in parts]
    heap = [(-(v[0] - v[-1]), i) for i, v in enumerate(nodes)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = nodes[a] + nodes[b][::-1]
        sort = np.argsort(-total, kind="stable")
        nodes[a] = nodes[b] = None
        nodes.append(total[sort])
        merged.append((a, b, sort))
        heapq.heappush(heap, (-(total[sort[0]] - total[sort[-1]]), len(nodes) - 1))
    # unroll: final place of every place of a node
    place: dict[int, np.ndarray] = {len(nodes) - 1: np.arange(ways)}
    for k in range(len(merged) - 1, -1, -1):
        a, b, sort = merged[k]
        mine = place.pop(n + k)
        at = np.empty(ways, dtype=np.int64)
        at[sort] = mine
        place[a] = at
        place[b] = at[::-1]
    out = np.empty((n, ways), dtype=np.int64)
    for i in range(n):
        out[i, order[i]] = place[i]
    return out


def _difference_groups(sizes: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """``difference`` for singletons: (slot of each group, slot sums)."""
    first = np.zeros((len(sizes), ways))
    first[:, 0] = sizes
    slot = difference(list(first))[:, 0]
    return slot, np.bincount(slot, weights=sizes, minlength=ways)


def _vectors(sums: pd.DataFrame, shards: int) -> tuple[list[int], np.ndarray]:
    """Cells in ascending order and their slot sums from rows (cell, slot, bytes)."""
    cells, at = np.unique(sums["cell"].to_numpy(np.int64), return_inverse=True)
    parts = np.zeros((len(cells), shards))
    parts[at, sums["slot"].to_numpy(np.int64)] = sums["bytes"].to_numpy(np.float64)
    return cells.tolist(), parts


def assign_groups(groups: DataFrame, shards: int, scratch: Scratch, groups_per_task: int = GROUPS_PER_TASK,
                  fan_in: int = FAN_IN) -> DataFrame:
    """Groups (digest unique, size, _n rows) with their shard."""
    ship(groups.sparkSession)
    total = groups.count()
    tasks = max(1, -(-total // groups_per_task))
    cells = groups.withColumn("cell", F.expr(f"pmod(xxhash64(digest), {tasks})").cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "digest"], ascending=[False, True], kind="stable")
        slot, _ = _difference_groups(pdf["size"].to_numpy(np.float64), shards)
        return pdf.assign(slot=slot)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        names, parts = _vectors(pdf, shards)
        return pd.DataFrame({"cell": np.repeat(names, shards), "slot": np.tile(np.arange(shards), len(names)),
                             "up": int(pdf["up"].iloc[0]), "up_slot": difference(list(parts)).ravel()})

    schema = "digest string, size long, _n long, cell int, slot int"
    local = scratch.write(cells.select("digest", "size", "_n", "cell").groupBy("cell").applyInPandas(run, schema),
                          "cells")
    level = 0
    while tasks > fan_in:
        # up to fan_in vectors of sums per task; a (cell, slot) holds at most
        # one task's groups of the level below
        tasks, level = -(-tasks // fan_in), level + 1
        sums = local.groupBy("cell", "slot").agg(F.sum("size").alias("bytes"))
        steps = scratch.write(sums.withColumn("up", F.expr(f"cell div {fan_in}").cast("int")).groupBy("up")
                              .applyInPandas(combine, "cell int, slot int, up int, up_slot int"), f"steps{level}")
        local = scratch.write(local.join(steps, ["cell", "slot"]).select(
            "digest", "size", "_n", F.col("up").alias("cell"), F.col("up_slot").alias("slot")), f"cells{level}")
    # at most fan_in x shards sums
    sums = local.groupBy("cell", "slot").agg(F.sum("size").alias("bytes")).toPandas()
    if not len(sums):
        return local.select("digest", "_n", F.col("slot").alias("shard"))
    names, parts = _vectors(sums, shards)
    final = difference(list(parts))
    rows = [(c, s, int(final[i, s])) for i, c in enumerate(names) for s in range(shards)]
    plan = F.broadcast(scratch.spark.createDataFrame(rows, "cell int, slot int, shard int"))
    return local.join(plan, ["cell", "slot"]).select("digest", "_n", "shard")


def number(rows: DataFrame, by: str, scratch: Scratch) -> DataFrame:
    """Gapless numbers from 0 within each value of ``by`` (few values), without
    bringing a value's rows together: places within partitions plus offsets."""
    ship(rows.sparkSession)
    fields = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            values = batch.column(by).to_numpy(zero_copy_only=False)
            place = np.empty(len(values), dtype=np.int64)
            for v in np.unique(values).tolist():
                at = np.flatnonzero(values == v)
                place[at] = seen.get(v, 0) + np.arange(len(at))
                seen[v] = seen.get(v, 0) + len(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(place)],
                names=[*batch.schema.names, "part", "place"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    placed = scratch.write(rows.mapInArrow(run, f"{schema}, part int, place long"), "placed")
    w = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition and value
    before = scratch.write(placed.groupBy(by, "part").agg(F.count(F.lit(1)).alias("rows"))
                           .select(by, "part", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("before")), "before")
    return (placed.join(broadcast_if_small(before), [by, "part"])
            .withColumn("slot", F.col("place") + F.col("before")).drop("part", "place", "before"))


def shard_documents(documents: DataFrame, shards: int = 24, groups_per_task: int = GROUPS_PER_TASK,
                    fan_in: int = FAN_IN) -> DataFrame:
    """Shard of every document by bytes; equal texts are one group.

    Returns (doc_id, size, text_crc32, shard, slot).  Size: UTF-8 bytes of the
    text plus 8; a null text has none and groups with the empty ones.  Repeated
    rows are placed like any others; an empty table gives no rows; other
    columns are ignored.  A group larger than a shard's mean sets the spread:
    indivisible groups allow no less.
    """
    scratch = Scratch(documents.sparkSession, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.write(pick(documents, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("digest")), "rows")
    groups = scratch.write(rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("_n")),
                           "groups")
    placed = assign_groups(groups, shards, scratch, groups_per_task, fan_in)
    joined = join_on_hot_key(rows, placed, "digest", total=rows.count())
    return number(joined.select("doc_id", "size", "text_crc32", "shard"), "shard", scratch)


def write_shards(documents: DataFrame, path: str, shards: int = 24) -> DataFrame:
    """Write the documents' assignments as one folder per shard, sorted by
    slot, and return them read back."""
    out = shard_documents(documents, shards)
    out.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot") \
        .write.mode("overwrite").partitionBy("shard").parquet(path)
    return documents.sparkSession.read.parquet(path)
