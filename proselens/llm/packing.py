"""Best-fit packing of token sequences (operator 1).

Bulk-synchronous best fit over the table of pieces.  Sizes go down in bands:
pieces over half of the capacity open a sequence each; then for each band of
smaller sizes, rounds of

1. range-sort the band's pieces and all gaps together, largest first;
2. a successor sweep in every range: each piece, largest first, takes the
   smallest gap of its range that still holds it;
3. across ranges: what a range could not place and what it left untouched is
   known by two counts per range; a stack over these counts deals runs of
   piece ranks to runs of gap ranks of the nearest larger range, so that no
   two pieces claim one place;
4. the gaps shrink by what they took, and the next round begins.

A band whose round places few pieces opens new sequences by the same sweep.
Only counts per range reach the driver.  Pieces and gaps are rows of a few
numbers; ids stay in the table of pieces, which is written once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proselens.llm import tokens
from proselens.llm.common import Scratch, pick, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
STATE = "kind int, key long, size long, part int, rank long, bin long, offset long, fresh int"
GAP, ITEM = 0, 1
# Pieces and gaps per sweep task: bounds its memory.
ROWS_PER_TASK = 50_000
# A round that places less than this share of a band's pieces is the last one
# before the band opens new sequences.
LEAST_SHARE = 0.02
# Sequences that a range opens at least, if there are so many: a task then has
# up to OPEN_AT_LEAST * capacity of the smallest pieces.
OPEN_AT_LEAST = 20
_BYTES_PER_BATCH = 8 << 20


def tokenize(documents: DataFrame, vocabulary: str, pattern: str, capacity: int) -> DataFrame:
    """One row per piece of each document: PIECES.  Null texts count as empty;
    a repeated row is packed again."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                            ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.ids(text.as_py() or "")
                for i, (s, n) in enumerate(tokens.cut(len(ids), capacity)):
                    raw = ids[s:s + n].tobytes()
                    rows.append((doc, i, s, n, tokens.crc(raw), raw))
                held += 4 * len(ids)
                if held > _BYTES_PER_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                                     schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return pick(documents, "doc_id", "text").mapInArrow(run, PIECES)


class _Gaps:
    """Gaps of one range by size; ``take`` gives the smallest that fit."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[np.ndarray]] = {}

    def add(self, size: int, index: np.ndarray) -> None:
        if size <= 0 or not len(index):
            return
        if size not in self.runs:
            insort(self.sizes, size)
            self.runs[size] = []
        self.runs[size].append(index)

    def take(self, least: int, most: int) -> tuple[int, np.ndarray] | None:
        """Up to ``most`` gaps of the smallest size that is at least ``least``."""
        at = bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        run = self.runs[size][-1]
        if len(run) > most:
            self.runs[size][-1], run = run[most:], run[:most]
        else:
            self.runs[size].pop()
            if not self.runs[size]:
                del self.runs[size]
                self.sizes.pop(at)
        return size, run


def sweep(kind: np.ndarray, key: np.ndarray, size: np.ndarray, capacity: int, opens: bool) -> dict[str, np.ndarray]:
    """Successor sweep of one range sorted by descending size, gaps first.

    Equal pieces go in runs: a gap takes as many of them as it holds.  With
    ``opens`` a piece without a gap opens a sequence, named by its own key.
    ``rank`` numbers what stays for the exchange between ranges: pieces
    without a place and gaps that took nothing, each from 0, largest first;
    -1 elsewhere.
    """
    n = len(kind)
    item, gap = np.flatnonzero(kind == ITEM), np.flatnonzero(kind == GAP)
    left = np.where(kind == GAP, size, 0)
    bins, offset = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    # by gap number; new sequences are appended
    name_a, room_a = key[gap].astype(np.int64), size[gap].astype(np.int64)
    touched = np.zeros(len(gap), dtype=bool)
    open_gaps = _Gaps()
    edges = np.flatnonzero(np.diff(room_a, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(room_a)]):
        open_gaps.add(int(room_a[a]), np.arange(a, b))
    sizes = size[item]
    start = 0
    while start < len(item):
        s = int(sizes[start])
        end = start + int(np.searchsorted(-sizes[start:], -s, side="right"))
        at = start
        while at < end:
            got = open_gaps.take(s, end - at)
            if got is None:
                if not opens:
                    break
                each = capacity // s
                count = -(-(end - at) // each)
                fresh = np.arange(len(room_a), len(room_a) + count)
                name_a = np.append(name_a, key[item[at:end:each]])
                room_a = np.append(room_a, np.full(count, capacity))
                touched = np.append(touched, np.ones(count, dtype=bool))
                open_gaps.add(capacity, fresh)
                continue
            g, run = got
            each = g // s
            need = -(-(end - at) // each)
            if need < len(run):
                open_gaps.add(g, run[need:])
                run = run[:need]
            m = min(end - at, each * len(run))
            j = np.arange(m)
            rows = item[at:at + m]
            bins[rows] = name_a[run[j // each]]
            offset[rows] = capacity - g + (j % each) * s
            used = np.full(len(run), each)
            used[-1] = m - each * (len(run) - 1)
            room_a[run] = g - used * s
            touched[run] = True
            open_gaps.add(g - each * s, run[:-1])
            open_gaps.add(int(g - used[-1] * s), run[-1:])
            at += m
        start = end
    left[gap] = room_a[:len(gap)]
    rank = np.full(n, -1, dtype=np.int64)
    lone, whole = item[bins[item] < 0], gap[~touched[:len(gap)]]
    rank[lone], rank[whole] = np.arange(len(lone)), np.arange(len(whole))
    left[item] = size[item]
    return {"size": left, "bin": bins, "offset": offset, "rank": rank,
            "new_key": name_a[len(gap):], "new_size": room_a[len(gap):]}


def _sweeps(events: DataFrame, parts: int, capacity: int, opens: bool) -> DataFrame:
    order = [F.desc("size"), F.asc("kind"), F.asc("key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        kind, key, size = (table.column(c).to_numpy() for c in ("kind", "key", "size"))
        got = sweep(kind, key, size, capacity, opens)
        new = len(got["new_key"])
        tail = lambda a, fill: np.concatenate([a, np.full(new, fill, dtype=a.dtype)])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            pa.array(tail(kind.astype(np.int32), GAP)),
            pa.array(np.concatenate([key, got["new_key"]])),
            pa.array(np.concatenate([got["size"], got["new_size"]])),
            pa.array(np.full(len(kind) + new, part, dtype=np.int32)),
            pa.array(tail(got["rank"], -1)), pa.array(tail(got["bin"], -1)), pa.array(tail(got["offset"], -1)),
            pa.array(np.concatenate([np.zeros(len(kind), np.int32), np.ones(new, np.int32)])),
        ], names=["kind", "key", "size", "part", "rank", "bin", "offset", "fresh"])

    sorted_ = events.select("kind", "key", "size").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(run, STATE)


def deal(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Deal pieces of a range to gaps of the nearest larger range.

    ``ranges``: (part, pieces, their largest, gaps, their smallest), from the
    largest sizes down.  Returns runs (piece part, first piece rank, pieces,
    gap part, first gap rank, pieces per gap).
    """
    stack: list[list[int]] = []
    out = []
    for part, items, largest, gaps, smallest in ranges:
        first = 0
        while items and stack:
            q, top, least = stack[-1]
            each = max(1, least // largest)
            t = min(top, -(-items // each))
            m = min(items, t * each)
            out.append((part, first, m, q, top - t, each))
            first, items = first + m, items - m
            stack[-1][1] -= t
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps, smallest])
    return out


def _exchange(swept: DataFrame, runs: list[tuple], capacity: int) -> DataFrame:
    """Apply the runs of ``deal`` to a swept table: pieces get their place,
    gaps their new size."""
    spark = swept.sparkSession
    base, rows = 0, []
    for part, first, m, q, gap_first, each in runs:
        rows.append((ITEM, part, first, first + m, each, base))
        count = -(-m // each)
        rows.append((GAP, q, gap_first, gap_first + count, 1, base))
        base += count
    # at most four runs per range: bounded by the number of sweep tasks
    plan = F.broadcast(spark.createDataFrame(rows, "kind int, part int, a long, b long, each long, base long"))
    hit = (swept.filter("rank >= 0").alias("s")
           .join(plan.alias("p"), (F.col("s.kind") == F.col("p.kind")) & (F.col("s.part") == F.col("p.part"))
                 & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
           .select("s.kind", "key", "size", F.expr("base + (rank - a) div each").alias("match"),
                   F.expr("(rank - a) % each").alias("turn")))
    w = Window.partitionBy("match").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    items = (hit.filter(F.col("kind") == ITEM)
             .select("match", F.col("key").alias("key"), "size",
                     F.coalesce(F.sum("size").over(w), F.lit(0)).alias("before")))
    gaps = hit.filter(F.col("kind") == GAP).select("match", F.col("key").alias("bin"), F.col("size").alias("gap"))
    placed = items.join(gaps, "match").select(
        F.lit(ITEM).alias("kind"), "key", F.col("bin").alias("to"),
        (F.lit(capacity) - F.col("gap") + F.col("before")).alias("at"), F.lit(None).cast("long").alias("rest"))
    taken = items.groupBy("match").agg(F.sum("size").alias("took"))
    shrunk = gaps.join(taken, "match").select(
        F.lit(GAP).alias("kind"), F.col("bin").alias("key"), F.lit(None).cast("long").alias("to"),
        F.lit(None).cast("long").alias("at"), (F.col("gap") - F.col("took")).alias("rest"))
    change = placed.unionByName(shrunk)
    return (swept.join(change, ["kind", "key"], "left")
            .select("kind", "key", F.coalesce("rest", "size").alias("size"), "part", "rank",
                    F.coalesce("to", "bin").alias("bin"), F.coalesce("at", "offset").alias("offset"), "fresh"))


def pack_sizes(sizes: DataFrame, capacity: int, scratch: Scratch, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pack rows (key unique, size from 1 to ``capacity``); returns (key, bin,
    offset).  ``bin`` is the key of the sequence's first piece."""
    blank = [F.lit(0).alias("part"), F.lit(-1).cast("long").alias("rank")]
    half = capacity // 2
    big = F.col("size") > half
    start = sizes.select(
        F.lit(ITEM).alias("kind"), "key", F.col("size").cast("long").alias("size"), *blank,
        F.when(big, F.col("key")).otherwise(F.lit(-1)).cast("long").alias("bin"),
        F.when(big, 0).otherwise(F.lit(-1)).cast("long").alias("offset"), F.lit(0).alias("fresh"))
    opened = start.filter(big & (F.col("size") < capacity)).select(
        F.lit(GAP).alias("kind"), "key", (capacity - F.col("size")).alias("size"), *blank,
        F.lit(-1).cast("long").alias("bin"), F.lit(-1).cast("long").alias("offset"), F.lit(0).alias("fresh"))
    done = [start.filter(big).select("key", "bin", "offset")]
    waiting = start.filter(~big)
    gaps, live, gap_table = opened, [], ""
    hi, turn = half, 0
    while hi >= 1:
        lo = max(hi // 2, 0) if hi > capacity // 16 else 0
        band = waiting.filter(F.col("size").between(lo + 1, hi)).select("kind", "key", "size")
        while True:
            # gaps too small for the band stay as they are
            fits, rest = gaps.filter(F.col("size") > lo), gaps.filter(F.col("size") <= lo)
            events = band.unionByName(fits.select("kind", "key", "size"))
            facts = {r["kind"]: (r["n"], r["total"]) for r in events.groupBy("kind").agg(
                F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).collect()}
            (todo, total), (waiting_gaps, _) = facts.get(ITEM, (0, 0)), facts.get(GAP, (0, 0))
            if not todo:
                break
            parts = -(-(todo + waiting_gaps) // rows_per_task)
            opens = bool(turn < 0) or not waiting_gaps
            if opens:
                # each range may leave its last sequence open: let it open many
                parts = max(min(parts, total // (OPEN_AT_LEAST * capacity)), -(-waiting_gaps // rows_per_task), 1)
            name = f"sweep{len(live)}"
            swept = scratch.write(_sweeps(events, parts, capacity, opens), name)
            live.append(name)
            per = swept.groupBy("part").agg(
                F.sum(((F.col("kind") == ITEM) & (F.col("rank") >= 0)).cast("long")).alias("items"),
                F.max(F.when((F.col("kind") == ITEM) & (F.col("rank") >= 0), F.col("size"))).alias("largest"),
                F.sum(((F.col("kind") == GAP) & (F.col("rank") >= 0)).cast("long")).alias("gaps"),
                F.min(F.when((F.col("kind") == GAP) & (F.col("rank") >= 0), F.col("size"))).alias("smallest"))
            ranges = sorted((r["part"], r["items"], r["largest"] or 0, r["gaps"], r["smallest"] or 0)
                            for r in per.collect())
            runs = deal(ranges)
            if runs:
                name = f"exchange{len(live)}"
                swept = scratch.write(_exchange(swept, runs, capacity), name)
                live.append(name)
            done.append(swept.filter((F.col("kind") == ITEM) & (F.col("bin") >= 0)).select("key", "bin", "offset"))
            band = swept.filter((F.col("kind") == ITEM) & (F.col("bin") < 0)).select("kind", "key", "size")
            before, name = gap_table, f"gaps{len(live)}"
            gaps = scratch.write(
                rest.select("kind", "key", "size").unionByName(
                    swept.filter((F.col("kind") == GAP) & (F.col("size") > 0)).select("kind", "key", "size")), name)
            live.append(name)
            gap_table = name
            if before:
                scratch.drop(before)
            stuck = sum(r[1] for r in ranges) - sum(r[2] for r in runs)
            if not stuck:
                break
            # one range sees all gaps: what it left fits nowhere
            turn = -1 if len(ranges) == 1 or stuck > (1 - LEAST_SHARE) * todo else 0
        turn = 0
        hi = lo
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(documents: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024,
         rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns PIECES plus sequence_id and offset.  A null text is empty (one
    end id); repeated rows and repeated ids are packed like any others; an
    empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "pack")
    pieces = scratch.write(
        tokenize(documents, vocabulary, pattern, capacity).withColumn("key", F.monotonically_increasing_id()),
        "pieces", "zstd")
    places = pack_sizes(pieces.select("key", F.col("length").alias("size")), capacity, scratch, rows_per_task)
    return (pieces.join(places, "key")
            .select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"),
                    "offset", "ids"))
