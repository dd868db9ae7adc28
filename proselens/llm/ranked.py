"""Ranked lexical search with range-maximum tables (operator 11).

One pass over the texts counts the terms that any query asks for and writes a
short vector per document.  The counts of the whole table give every term's
weight; then each task gathers its vectors into shards.  In a shard every
query term has a posting list in one document order and a sparse table of the
maxima of its impacts, so the largest impact within any interval of documents
is two look-ups.  Their sum over a query's terms bounds all scores in the
interval: intervals are taken best bound first, split at the document of
largest impact, which is scored, and dropped when their bound is below the
query's k-th best score so far.  A task carries its best documents from shard
to shard, and searches of ever larger samples give all tasks a score to start
from, so most shards end after a few splits.  Nothing is cut: a dropped
interval cannot hold a document of the answer.

Postings never shuffle; what shuffles are each task's best ``k`` per query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselens.llm.common import Scratch, pick, ship

# The term pattern, of which A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of query terms per block: a block and its vocabulary are broadcast.
BLOCK_BYTES = 8 << 20
# Postings of a shard: bounds its sparse tables (four bytes a level).
SHARD_POSTINGS = 1_000_000
# Bytes of a text that are split into terms at a time.
STRETCH = 4 << 20
# Intervals split at a time, and the documents below which one is scored
# whole instead of being split further.
WAVE, LEAF = 32, 8
# A sample for first scores is this many times smaller than the next one, and
# holds at least LEAST_SAMPLE documents.
STEP, LEAST_SAMPLE = 16, 4096

_VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "item long, doc_id long, score long"


def _byte_table() -> bytes:
    """Separators become spaces, A-Z lower case, all else itself."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(out)


_BYTES = _byte_table()


def count_terms(raw: bytes, vocabulary: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of terms of a UTF-8 text, and how often each known one occurs."""
    raw = raw.translate(_BYTES)
    n, counts, at = 0, {}, 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= STRETCH else raw.find(b" ", at + STRETCH)
        end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        n += len(words)
        for w, c in Counter(words).items():
            t = vocabulary.get(w)
            if t is not None:
                counts[t] = counts.get(t, 0) + c
        at = end
    return n, counts


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids, ns, offsets, terms, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, counts = count_terms(text.as_buffer().to_pybytes(), known) if text.is_valid else (0, {})
                if n:
                    ids.append(doc_id)
                    ns.append(n)
                    terms.extend(counts.keys())
                    tfs.extend(counts.values())
                    offsets.append(len(terms))
            offs = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                 pa.ListArray.from_arrays(offs, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offs, pa.array(tfs, pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _VECTOR)


def _divided(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(50 n N) div L, with whole numbers of any size."""
    if int(n.max(initial=0)) * 50 * documents < 1 << 62:
        return 50 * n * documents // total
    return np.array([50 * int(x) * documents // total for x in n], np.int64)


class Shard:
    """Posting lists and sparse tables of a run of documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 weights: np.ndarray, documents: int, total: int) -> None:
        # neighbours of like length: tight bounds, as impacts depend on it
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        self.ids, self.size = ids[order], len(n)
        where = np.repeat(place, lengths)
        m = 50 + _divided(n, documents, total)
        m = np.repeat(m, lengths)
        tf = tfs.astype(np.int64)
        impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
        key = terms.astype(np.int64) * self.size + where
        by = np.argsort(key)
        self.keys, self.impact = key[by], impact[by]
        self.where = where[by]
        counts = np.bincount(terms, minlength=len(weights))
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        # bounds only need single precision, rounded up
        level = np.nextafter(self.impact.astype(np.float32), np.float32(np.inf))
        levels = [level]
        for k in range(int(counts.max(initial=1)).bit_length() - 1):
            wider = level.copy()
            np.maximum(level[:-(1 << k)], level[1 << k:], out=wider[:-(1 << k)])
            levels.append(level := wider)
        self.table = np.concatenate(levels)
        self.postings = len(key)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Largest impact within each range of postings, 0 in an empty one."""
        length = hi - lo
        some = length > 0
        k = np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1
        base = k.astype(np.int64) * self.postings
        a = np.where(some, base + lo, 0)
        b = np.where(some, base + hi - (1 << k.astype(np.int64)), 0)
        return np.where(some, np.maximum(self.table[a], self.table[b]), 0)

    def search(self, terms: np.ndarray, best: "Best") -> None:
        """Offer ``best`` every document that it may want."""
        terms = terms[self.ends[terms] > self.starts[terms]]
        if not len(terms):
            return
        base = terms.astype(np.int64) * self.size
        a, b = np.zeros(1, np.int64), np.full(1, self.size, np.int64)
        lo, hi = self.starts[terms][None, :], self.ends[terms][None, :]
        top = self.maxima(lo, hi)
        bound = top.sum(1, dtype=np.float64)
        while True:
            open_ = bound >= best.least
            if not open_.all():
                a, b, lo, hi, top, bound = (x[open_] for x in (a, b, lo, hi, top, bound))
            if not len(a):
                return
            if len(a) > WAVE:
                pick_ = np.argpartition(-bound, WAVE - 1)
                now, rest = pick_[:WAVE], pick_[WAVE:]
            else:
                now, rest = np.arange(len(a)), pick_none
            kept = [x[rest] for x in (a, b, lo, hi, top, bound)]
            a, b, lo, hi, top = (x[now] for x in (a, b, lo, hi, top))
            small = b - a <= LEAF
            if small.any():
                self._score_ranges(lo[small], hi[small], best)
                a, b, lo, hi, top = (x[~small] for x in (a, b, lo, hi, top))
            if len(a):
                # the document of the largest impact splits its interval
                row, col = np.arange(len(a)), top.argmax(1)
                l, h = lo[row, col].tolist(), hi[row, col].tolist()
                d = self.where[[x + int(self.impact[x:y].argmax()) for x, y in zip(l, h)]]
                at = np.searchsorted(self.keys, base[None, :] + d[:, None])
                held = (at < hi) & (self.where[np.minimum(at, self.postings - 1)] == d[:, None])
                score = np.where(held, self.impact[np.minimum(at, self.postings - 1)], 0).sum(1)
                best.offer(self.ids[d], score)
                a2, b2 = np.concatenate([a, d + 1]), np.concatenate([d, b])
                lo2, hi2 = np.concatenate([lo, at + held]), np.concatenate([at, hi])
                top2 = self.maxima(lo2, hi2)
                new = [a2, b2, lo2, hi2, top2, top2.sum(1, dtype=np.float64)]
                kept = [np.concatenate(p) for p in zip(kept, new)]
            a, b, lo, hi, top, bound = kept

    def _score_ranges(self, lo: np.ndarray, hi: np.ndarray, best: "Best") -> None:
        """Score all documents with a posting in the ranges."""
        length = (hi - lo).ravel()
        total = int(length.sum())
        if not total:
            return
        ends = np.cumsum(length)
        at = np.repeat(lo.ravel() - (ends - length), length) + np.arange(total)
        docs, inverse = np.unique(self.where[at], return_inverse=True)
        score = np.zeros(len(docs), np.int64)
        np.add.at(score, inverse, self.impact[at])
        best.offer(self.ids[docs], score)


pick_none = np.zeros(0, np.int64)
# Null ids come after all others: they are held as the largest number.
NULL_ID = np.iinfo(np.int64).max


class Best:
    """The best ``k`` (score, id) so far, equal scores by smaller id."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least = k, max(1, least)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        s, i = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((i, -s))[:self.k]
        self.scores, self.ids = s[order], i[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def _search(vectors: DataFrame, asked, weights, documents: int, total: int, k: int,
            shard_postings: int) -> DataFrame:
    """Each task's best ``k`` documents of every query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, first = asked.value
        w = weights.value
        best = [Best(k, int(x)) for x in first]
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            shard = Shard(*(np.concatenate(c) for c in zip(*held)), w, documents, total)
            for terms, b in zip(queries, best):
                shard.search(terms, b)

        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            terms, tfs = batch.column(2), batch.column(3)
            part = (ids, batch.column(1).to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(),
                    tfs.flatten().to_numpy())
            held.append(part)
            size += len(part[3])
            if size >= shard_postings:
                flush()
                held, size = [], 0
        if held:
            flush()
        counts = [len(b.ids) for b in best]
        ids = np.concatenate([b.ids for b in best] or [pick_none])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), counts), pa.int64()),
             pa.array(ids, pa.int64(), mask=ids == NULL_ID),
             pa.array(np.concatenate([b.scores for b in best] or [pick_none]), pa.int64())],
            names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, _FOUND)


def query_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of the queries."""
    text = F.translate(F.col("text"), UPPER, LOWER)
    return pick(items, "item_id", "text").select(
        "item_id", F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES,
           shard_postings: int = SHARD_POSTINGS, step: int = STEP, least_sample: int = LEAST_SAMPLE) -> DataFrame:
    """The ``k`` best documents of each item: (item_id, rank, doc_id, score).

    A null text has no terms and an item without terms no rows; rows of one
    item_id are one query with the terms of them all; repeated documents are
    documents of their own, with ranks of their own; null doc_ids come last
    among equal scores, a null item_id is an item like others.  Empty tables
    give no rows, other columns are ignored.

    Queries go to the tasks in blocks of ``block_bytes`` of terms, each with a
    pass over the texts of its own.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    scratch = Scratch(spark, "ranked")
    texts = pick(docs, "doc_id", "text")
    asked_terms = scratch.write(query_terms(items), "queries")
    size = asked_terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for block in range(blocks):
        rows = asked_terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).groupBy("item_id").agg(
            F.collect_list("term").alias("terms")).collect()  # at most about block_bytes
        words = sorted({t for r in rows for t in r["terms"]})
        number = {w: i for i, w in enumerate(words)}
        queries = [np.array(sorted(number[t] for t in r["terms"]), np.int64) for r in rows]
        vocabulary = sc.broadcast({w.encode(): i for w, i in number.items()})
        vectors = scratch.write(_vectors(texts, vocabulary), f"vectors{block}")
        vocabulary.destroy()
        documents, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(words), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            frequency[r["t"]] = r["count"]  # one row per word of the block
        weights = sc.broadcast(np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequency], np.int64))
        numbered = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                         f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        first = np.zeros(len(rows), np.int64)
        share = 1
        while documents // (share * step) >= least_sample:
            share *= step
        while share >= 1:
            some = vectors if share == 1 else vectors.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(share)) == 0)
            asked = sc.broadcast((queries, first))
            found = scratch.write(_search(some, asked, weights, documents, max(1, total), k, shard_postings),
                                  f"found{block}-{share}")
            asked.destroy()
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            if share > 1:
                for r in ranked.filter(F.col("rank") == k).collect():  # one row per query of the block
                    first[r["item"]] = max(first[r["item"]], r["score"])
            share //= step
        weights.destroy()
        parts.append(ranked.join(numbered, "item").select("item_id", "rank", "doc_id", "score"))
        scratch.drop(f"vectors{block}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
