"""Benchmark decontamination (operator 5).

A document is contaminated by an item when some run of its words is within the
allowed word edit distance of the item.  Per item length:

1. item-sized windows: by the pigeonhole rule a run within e edits of an item
   of n words holds one of the item's runs of n // (e + 1) words unchanged;
   every such place names a window, and no other window can match;
2. windows and items are embedded by CGK random walks, in which edits become
   few differing places; several walks, each with several samples of places,
   put windows and items into buckets, and sharing one makes a candidate;
3. each candidate is verified by exact edit distance around its window.

All of it happens where the documents are: the items, in blocks of bounded
size, go to the tasks, and only matches come back.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import Scratch, pick, ship

# Items of one pass over the documents, and their bytes: bounds what goes to
# the tasks (one item may be longer).
ITEMS_PER_BLOCK = 20_000
BLOCK_BYTES = 16 << 20
# Items with fewer words are too common to reject a document for.
LEAST_WORDS = 5
SHARE = 0.2
WALKS, SAMPLES, PLACES = 6, 16, 2
HITS = "doc_id long, item_id long, start_word long, end_word long, distance int, item_words int"
_WORD = re.compile(r"\w+")
_FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = 256  # documents at a time


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edits(n: int, share: float) -> int:
    """Edits allowed for an item of ``n`` words; short ones must be exact."""
    return int(share * n) if n >= 8 else 0


def grams(ids: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each place on."""
    out = np.zeros(max(0, len(ids) - q + 1), np.uint64)
    for i in range(q):
        out += (ids[i:len(out) + i].astype(np.uint64) + np.uint64(7)) * _FACTORS[i]
        out ^= out >> np.uint64(29)
    return out


# Bytes of windows or regions that are looked at together.
_WINDOW_BYTES = 32 << 20


def embed(rows: np.ndarray, bits: np.ndarray, pad: int) -> np.ndarray:
    """CGK walk over rows of word numbers: step j puts out the word it stands
    on (``pad`` past the end) and moves on if the word's bit of step j is 1."""
    m, n = rows.shape
    steps = len(bits)
    out = np.empty((m, steps), np.int64)
    at = np.zeros(m, np.int64)
    padded = np.column_stack([rows, np.full(m, pad, rows.dtype)])
    every = np.arange(m)
    for j in range(steps):
        word = padded[every, np.minimum(at, n)]
        out[:, j] = word
        at += bits[j, word]
    return out


def nearest_run(items: np.ndarray, regions: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For rows of items and regions: the least edit distance of the item to
    any run of the region, and where that run ends (first such place); a run
    begins anywhere or, ``anchored``, where the region does."""
    m, n = items.shape
    place = np.arange(n + 1)
    row = np.broadcast_to(place, (m, n + 1)).astype(np.int32)
    best, end = row[:, n].copy(), np.zeros(m, np.int64)
    for j in range(regions.shape[1]):
        step = np.empty_like(row)
        step[:, 0] = j + 1 if anchored else 0
        step[:, 1:] = np.minimum(row[:, :-1] + (items != regions[:, j:j + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(step - place, axis=1) + place
        better = row[:, n] < best
        best[better], end[better] = row[better, n], j + 1
    return best, end


class Items:
    """A block of benchmark items, prepared for the scan."""

    def __init__(self, rows: list[tuple[int, str]], share: float, least_words: int, walks: int, samples: int,
                 places: int) -> None:
        texts = [(i, words_of(t)) for i, t in rows if i is not None]
        texts = [(i, w) for i, w in texts if len(w) >= least_words]
        # 0: any word that no item holds; the last number pads
        self.number = {w: k + 1 for k, w in enumerate(sorted({x for _, ws in texts for x in ws}))}
        self.pad = len(self.number) + 1
        by_length: dict[int, list] = defaultdict(list)
        for i, w in texts:
            by_length[len(w)].append((i, [self.number[x] for x in w]))
        self.ids = {n: np.array([i for i, _ in xs], np.int64) for n, xs in by_length.items()}
        self.rows = {n: np.array([r for _, r in xs], np.int64) for n, xs in by_length.items()}
        self.edits = {n: edits(n, share) for n in by_length}
        starts: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for n, rs in self.rows.items():
            q = min(64, n // (self.edits[n] + 1))
            for r in rs:
                for o, g in enumerate(grams(r, q).tolist()):
                    starts[q][g].add((n, o))
        self.gates = {q: (np.array(sorted(g), np.uint64), [sorted(g[x]) for x in sorted(g)]) for q, g in starts.items()}
        rng = np.random.default_rng(20240229)
        # bits of a step per word, places of a sample: the same for all lengths
        longest = max(self.rows, default=1)
        self.bits = [rng.integers(0, 2, (2 * longest, self.pad + 1), dtype=np.int8) for _ in range(walks)]
        self.samples = {n: [[np.sort(rng.choice(2 * n, min(places, 2 * n), replace=False)) for _ in range(samples)]
                            for _ in range(walks)] for n in self.rows}
        self.keys = {n: self._keys(rs, n) for n, rs in self.rows.items()}
        self.margin = longest + max(self.edits.values(), default=0) + 1

    def _keys(self, rows: np.ndarray, n: int) -> list[np.ndarray]:
        out = []
        for bits, samples in zip(self.bits, self.samples[n]):
            walked = embed(rows, bits[:2 * n], self.pad).astype(np.uint64)
            out += [(walked[:, s] * _FACTORS[:len(s)]).sum(axis=1, dtype=np.uint64) for s in samples]
        return out

    def candidates(self, windows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) numbers that share a bucket."""
        pairs = []
        for mine, theirs in zip(self._keys(windows, n), self.keys[n]):
            order = np.argsort(theirs, kind="stable")
            low = np.searchsorted(theirs[order], mine, "left")
            count = np.searchsorted(theirs[order], mine, "right") - low
            w = np.repeat(np.arange(len(mine)), count)
            at = np.repeat(low, count) + np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
            pairs.append(w * len(theirs) + order[at])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.ids[n]), both % len(self.ids[n])

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item id, first word, end, distance, item words): the
        best run of each text for each item within its edits."""
        if not self.rows:
            return []
        get, pad, gap = self.number.get, self.pad, [self.pad] * self.margin
        flat: list[int] = list(gap)
        begin, size = [], []
        for t in texts:
            w = [get(x, 0) for x in words_of(t)]
            begin.append(len(flat))
            size.append(len(w))
            flat += w
            flat += gap
        ids = np.array(flat, np.int64)
        begins, sizes = np.array(begin), np.array(size)
        wanted: dict[int, list[np.ndarray]] = defaultdict(list)
        for q, (hashes, uses) in self.gates.items():
            h = grams(ids, q)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hits = np.flatnonzero(hashes[at] == h)
            for k in np.unique(at[hits]).tolist():
                p = hits[at[hits] == k]
                for n, o in uses[k]:
                    wanted[n].append(p - o)
        found: dict[tuple[int, int], tuple] = {}
        for n, starts in wanted.items():
            e = self.edits[n]
            start = np.unique(np.maximum(np.concatenate(starts), 0))
            start = start[start + n + e < len(ids)]
            # as many windows at a time as fit the bound, however long the item
            for c in range(0, len(start), max(1, _WINDOW_BYTES // (8 * n))):
                some = start[c:c + max(1, _WINDOW_BYTES // (8 * n))]
                w, item = self.candidates(ids[some[:, None] + np.arange(n)], n)
                step = max(1, min(4096, _WINDOW_BYTES // (8 * (n + 2 * e))))
                for a in range(0, len(w), step):
                    self._verify(ids, n, e, some[w[a:a + step]], item[a:a + step], begins, sizes, found)
        return [(doc, i, f, s, d, n) for (doc, i), (f, s, d, n) in sorted(found.items())]

    def _verify(self, ids: np.ndarray, n: int, e: int, start: np.ndarray, item: np.ndarray, begins: np.ndarray,
                sizes: np.ndarray, found: dict) -> None:
        """Exact distances around the candidate windows; a run's first word is
        found by the same distance backwards from its end."""
        left = np.maximum(start - e, 0)
        distance, end = nearest_run(self.rows[n][item], ids[np.minimum(left[:, None] + np.arange(n + 2 * e), len(ids) - 1)])
        hits = np.flatnonzero(distance <= e)
        if not len(hits):
            return
        stops = left[hits] + end[hits]
        back = ids[np.maximum(stops[:, None] - 1 - np.arange(n + e), 0)]
        _, length = nearest_run(self.rows[n][item[hits], ::-1], back, anchored=True)
        for x, stop, run in zip(hits.tolist(), stops.tolist(), length.tolist()):
            doc = int(np.searchsorted(begins, stop - 1, "right")) - 1
            first = max(0, stop - run - int(begins[doc]))
            stop = min(stop - int(begins[doc]), int(sizes[doc]))
            d, key = int(distance[x]), (doc, int(self.ids[n][item[x]]))
            if key not in found or (d, first) < (found[key][2], found[key][0]):
                found[key] = (first, stop, d, n)


class _Blocks:
    """The benchmark's items in blocks of bounded size, one on the driver at a time."""

    def __init__(self, benchmark: DataFrame, share: float, least_words: int, walks: int, samples: int, places: int,
                 items_per_block: int) -> None:
        self.items = pick(benchmark, "item_id", "text").filter("item_id is not null and text is not null").distinct()
        self.options = (share, least_words, walks, samples, places)
        total, size = self.items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.count = max(1, -(-total // items_per_block), -(-size // BLOCK_BYTES))

    def broadcast(self, b: int) -> Broadcast:
        rows = (self.items.filter(F.expr(f"pmod(xxhash64(item_id), {self.count}) = {b}"))
                .orderBy("item_id", "text").collect())
        return self.items.sparkSession.sparkContext.broadcast(Items([(r[0], r[1]) for r in rows], *self.options))


def _hits(block: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = block.value
        for whole in batches:
            for first in range(0, whole.num_rows, _STEP):
                batch = whole.slice(first, _STEP)
                docs = batch.column(0).cast(pa.int64()).to_pylist()
                hits = prepared.scan(batch.column(1).to_pylist())
                columns = list(zip(*hits)) if hits else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[i] for i in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
                     pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.int32())],
                    names=["doc_id", "item_id", "start_word", "end_word", "distance", "item_words"])
    return run


def _clean(block: Broadcast, text: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = block.value
        for whole in batches:
            for first in range(0, whole.num_rows, _STEP):
                batch = whole.slice(first, _STEP)
                keep = np.ones(batch.num_rows, bool)
                keep[[hit[0] for hit in prepared.scan(batch.column(text).to_pylist())]] = False
                yield batch.filter(pa.array(keep))
    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, least_words: int = 1,
               walks: int = WALKS, samples: int = SAMPLES, places: int = PLACES,
               items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """HITS: one row per document row and item that it leaks, at the best run.

    Words are runs of letters and digits, lower-cased.  Items without words or
    under ``least_words`` words match nothing; items under eight words must
    appear unchanged.  Rows of one item id with different texts are one item,
    reported at the best run of any.  Null and empty texts hold nothing;
    repeated rows are searched each; an empty table on either side gives no
    rows; other columns are ignored.

    Several blocks of items are searched one after another, each block's hits
    being written before the next is read.
    """
    spark = documents.sparkSession
    ship(spark)
    blocks = _Blocks(benchmark, share, max(1, least_words), walks, samples, places, items_per_block)
    rows = pick(documents, "doc_id", "text")
    if blocks.count == 1:
        return rows.mapInArrow(_hits(blocks.broadcast(0)), HITS)
    scratch, out = Scratch(spark, "leaks"), None
    for b in range(blocks.count):
        block = blocks.broadcast(b)
        part = scratch.write(rows.mapInArrow(_hits(block), HITS), f"hits{b}")
        block.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS,
               walks: int = WALKS, samples: int = SAMPLES, places: int = PLACES,
               items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """The documents, all their columns, that leak no item of ``least_words``
    words or more; rows are filtered where they are scanned, those without an
    id like any others."""
    spark = documents.sparkSession
    ship(spark)
    blocks = _Blocks(benchmark, share, max(1, least_words), walks, samples, places, items_per_block)
    text = [c.lower() for c in documents.columns].index("text")
    scratch, out = Scratch(spark, "clean"), documents
    for b in range(blocks.count):
        block = blocks.broadcast(b)
        out = out.mapInArrow(_clean(block, text), documents.schema)
        if blocks.count > 1:
            out = scratch.write(out, f"block{b}")
            block.destroy()
            scratch.drop(f"block{b - 1}") if b else None
    return out
