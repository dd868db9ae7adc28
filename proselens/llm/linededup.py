"""Line deduplication by pairwise alignment (operator 6).

Lines end at line breaks and sentence ends, and inside a sentence before words
picked by their neighbours alone: the least hash of every PICK_WORDS words in a
row.  Two texts that share n words in a row therefore share all their lines but
for PICK_WORDS - 1 words at either end, whatever stands around them.  Each line
begins a run of lines, as many as hold the words of a block.  The earliest
holder (by doc_id) of a run pairs with every later one: one row per line,
whatever they share, and whoever holds a block has a partner for each of its
runs.  Pairs are aligned by patience diff over their line hashes, and runs that
one rising sequence leaves out (moved or repeated passages) are looked up in
the earlier text, so each common run is found; blocks are widened word by word past the ends of their lines, and those of
enough words are deleted from the later document.  The earliest holder of a run
always keeps it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import HOT_KEYS, Scratch, fresh, join_on_hot_key, pick, ship

# A block of at least so many words is deleted.
BLOCK_WORDS = 25
# In each sentence one of so many words in a row begins a line, at least.
PICK_WORDS = 12
_WORD = re.compile(r"\S+")
_BATCH = 512
_MEMO_WORDS = 400_000
_PLACE = (1 << 31) - 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


# Hashes of words; the lowest bit says that the word ends a sentence.
_MEMO: dict[str, int] = {}


def _learn(words: list[str]) -> None:
    """Make sure that every word has its hash."""
    if len(_MEMO) > _MEMO_WORDS:
        _MEMO.clear()
    digest = xxhash.xxh3_64_intdigest
    for w in set(words).difference(_MEMO):
        _MEMO[w] = digest(w.lower()) & ~1 | (w[-1] in ".!?")


def cut(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each line and the number of words)."""
    words: list[str] = []
    begins = []
    for part in text.replace("\r", "\n").split("\n"):
        some = part.split()
        if some:
            begins.append(len(words))
            words += some
    _learn(words)
    h = np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))
    opens = np.zeros(len(h), bool)
    opens[begins] = True
    opens[1:] |= (h[:-1] & np.uint64(1)).astype(bool)
    if len(h) >= PICK_WORDS:
        # of equal words the last, so that the choice depends on these words only
        keys = (h >> np.uint64(33)).view(np.int64) << 31 | _PLACE - np.arange(len(h))
        least = window_minima(keys, PICK_WORDS)
        sentence = np.cumsum(opens)
        inside = sentence[:1 - PICK_WORDS] == sentence[PICK_WORDS - 1:]
        opens[_PLACE - (least[inside] & _PLACE)] = True
    return h, np.append(np.flatnonzero(opens), len(h))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by doubling stretches."""
    least, reach = values, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return least if reach == width else np.minimum(least[:len(values) - width + 1], least[width - reach:])


def packed(words: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """31 bits of each word's hash, and in the lowest bit whether it begins a line."""
    out = (words >> np.uint64(33) << np.uint64(1)).astype(np.uint32)
    out[lines[:-1]] |= np.uint32(1)
    return out.view(np.int32)


def unpacked(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = tokens.view(np.uint32)
    return (x >> np.uint32(1)).astype(np.uint64), np.append(np.flatnonzero(x & np.uint32(1)), len(x))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]))
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64)
                      for b in (_BASE, _BACK)]
    return _POWERS


def hashes_of(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes (int64) of the runs of words from first to before end."""
    n = len(words)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], dtype=np.uint64, out=sums[1:])
    x = (sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def run_ends(lines: np.ndarray, least: int) -> np.ndarray:
    """For each line the first line by which ``least`` words have passed;
    only the lines before which that many words are left, a prefix of all."""
    ends = np.searchsorted(lines, lines[:-1] + least)
    return ends[ends < len(lines)]


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence, by patience piles."""
    from bisect import bisect_left

    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(later: list[int], earlier: list[int]) -> list[tuple[int, int]]:
    """Patience diff: (later line, earlier line) pairs, rising in both.

    Within a region the equal ends are matched, then the lines unique in both
    (or, if there are none, the n-th copies of each line) are anchors, and the
    regions between anchors are aligned in turn.
    """
    matched: list[tuple[int, int]] = []
    todo = [(0, len(later), 0, len(earlier))]
    while todo:
        b0, b1, a0, a1 = todo.pop()
        while b0 < b1 and a0 < a1 and later[b0] == earlier[a0]:
            matched.append((b0, a0))
            b0, a0 = b0 + 1, a0 + 1
        while b0 < b1 and a0 < a1 and later[b1 - 1] == earlier[a1 - 1]:
            b1, a1 = b1 - 1, a1 - 1
            matched.append((b1, a1))
        if b0 == b1 or a0 == a1:
            continue
        nb, na = Counter(later[b0:b1]), Counter(earlier[a0:a1])
        once = {h for h, c in nb.items() if c == 1 and na.get(h) == 1}
        if once:
            where = {earlier[i]: i for i in range(a0, a1) if earlier[i] in once}
            anchors = [(i, where[later[i]]) for i in range(b0, b1) if later[i] in once]
        else:
            seen: Counter = Counter()
            copy = {}
            for i in range(a0, a1):
                if earlier[i] in nb:
                    copy[earlier[i], seen[earlier[i]]] = i
                    seen[earlier[i]] += 1
            seen.clear()
            anchors = []
            for i in range(b0, b1):
                if (later[i], seen[later[i]]) in copy:
                    anchors.append((i, copy[later[i], seen[later[i]]]))
                seen[later[i]] += 1
        if not anchors:
            continue
        kept = [anchors[i] for i in _rising([a for _, a in anchors])]
        matched += kept
        edges = [(b0 - 1, a0 - 1), *kept, (b1, a1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:]) if p + 1 < r and q + 1 < s]
    return sorted(matched)


def widened(later: list[int], earlier: list[int], first: int, end: int, start: int) -> tuple[int, int]:
    """Words first to before end of the later text, which the earlier one holds
    from start on, as far to either side as both texts agree."""
    stop = start + end - first
    while first and start and later[first - 1] == earlier[start - 1]:
        first, start = first - 1, start - 1
    while end < len(later) and stop < len(earlier) and later[end] == earlier[stop]:
        end, stop = end + 1, stop + 1
    return first, end


class Holder:
    """An earlier text as its later partners look it up: its words, the hashes
    of its lines, and where each of its runs first begins."""

    def __init__(self, words: np.ndarray, lines: np.ndarray, least: int) -> None:
        self.words, self.begins = words.tolist(), lines.tolist()
        self.lines = hashes_of(words, lines[:-1], lines[1:]).tolist()
        ends = run_ends(lines, least)
        self.runs: dict[int, int] = {}
        for a, h in enumerate(hashes_of(words, lines[:len(ends)], lines[ends]).tolist()):
            self.runs.setdefault(h, a)


def blocks(later: np.ndarray, later_lines: np.ndarray, holder: Holder, least: int) -> list[tuple[int, int, int, int]]:
    """(first line, end line, first word, end word) of the blocks of the later
    text that the earlier one holds.  A text is its words' hashes and, as of
    ``cut``, where its lines begin; lines are those that match as a whole.

    Together the blocks hold each run of whole lines of at least ``least``
    words that stands anywhere in the earlier text.
    """
    out: list[tuple[int, int, int, int]] = []
    mine, theirs = later.tolist(), holder.words
    my_lines = hashes_of(later, later_lines[:-1], later_lines[1:]).tolist()
    their_lines, where = holder.lines, holder.runs

    def add(i: int, j: int, a: int) -> None:
        first, end = widened(mine, theirs, int(later_lines[i]), int(later_lines[j]), holder.begins[a])
        if end - first >= least:
            out.append((i, j, first, end))

    run: list[tuple[int, int]] = []
    for b, a in [*align(my_lines, their_lines), (-9, -9)]:
        if run and (b, a) != (run[-1][0] + 1, run[-1][1] + 1):
            add(run[0][0], run[-1][0] + 1, run[0][1])
            run = []
        run.append((b, a))
    gone = np.zeros(len(later) + 1, bool)
    for _, _, first, end in out:
        gone[first:end] = True
    ends = run_ends(later_lines, least)
    for i, h in enumerate(hashes_of(later, later_lines[:len(ends)], later_lines[ends]).tolist()):
        if h in where and not gone[later_lines[i]:later_lines[ends[i]]].all():
            a, n = where[h], int(ends[i]) - i
            while i + n < len(my_lines) and a + n < len(their_lines) and my_lines[i + n] == their_lines[a + n]:
                n += 1
            add(i, i + n, a)
            gone[out[-1][2]:out[-1][3]] = True
    return sorted(out)


def _key() -> Column:
    return F.xxhash64(F.col("`doc_id`"), F.col("`text`"))


def find_blocks(documents: DataFrame, least_words: int = BLOCK_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Blocks to delete: (key, doc_id, earlier_id, first_line, end_line,
    first_word, end_word, words).

    ``key`` names a document by id and text: rows that repeat both are one
    document, which is never its own duplicate.  Null ids come first in the
    order.  Null and empty texts have no lines; an empty table gives no rows;
    other columns are ignored.
    """
    ship(documents.sparkSession)
    scratch = scratch or Scratch(documents.sparkSession, "lines")
    schema = "key long, doc_id long, tokens array<int>, runs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(first, _BATCH)
                tokens, runs = [], []
                for t in batch.column(2).to_pylist():
                    h, at = cut(t)
                    tokens.append(packed(h, at))
                    ends = run_ends(at, least_words)
                    runs.append(np.unique(hashes_of(h, at[:len(ends)], at[ends])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(tokens, pa.list_(pa.int32())),
                     pa.array(runs, pa.list_(pa.int64()))], names=schema.replace(",", "").split()[::2])

    texts = (pick(documents, "doc_id", "text").filter("text is not null")
             .select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    lines = scratch.write(texts.mapInArrow(run, schema), "lines")
    # one row per document: repeated rows have equal lines
    flat = lines.select("key", "doc_id", F.explode("runs").alias("run"))
    holders = scratch.write(
        flat.groupBy("run").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select("run", F.col("first.key").alias("earlier"), "_n"), "holders")
    total = holders.agg(F.sum("_n")).first()[0] or 0
    shared = join_on_hot_key(flat.select("run", "key"), holders, "run", total=total)
    pairs = scratch.write(shared.filter("key <> earlier").select("key", "earlier").distinct(), "pairs")
    scratch.drop("holders")
    whole = lines.select("key", "doc_id", "tokens").dropDuplicates(["key"])
    theirs = whole.select(F.col("key").alias("earlier"), F.col("doc_id").alias("earlier_id"),
                          F.col("tokens").alias("earlier_tokens"))
    # a holder of very many pairs is dealt into shares of its pairs, each with
    # a copy of its text; fewer than HOT_KEYS holders have that many
    share = max(2, pairs.count() // HOT_KEYS)
    hot = F.broadcast(pairs.groupBy("earlier").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= share)
                      .select("earlier", (F.floor(F.col("_n") / share) + 1).cast("int").alias("_shares")))
    names = ["key", "doc_id", "earlier", "earlier_id", "tokens", "earlier_tokens"]
    few = pairs.join(hot, "earlier", "left_anti").join(whole, "key").join(theirs, "earlier").select(names)
    dealt = pairs.join(hot, "earlier").withColumn("_share", F.pmod(F.xxhash64("key"), F.col("_shares")).cast("int"))
    copies = theirs.join(hot, "earlier").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    many = dealt.drop("_shares").join(whole, "key").join(copies.drop("_shares"), ["earlier", "_share"]).select(names)
    both = few.unionByName(many)
    found = ("key long, doc_id long, earlier_id long, first_line int, end_line int, first_word int, end_word int, "
             "words int")
    names = found.replace(",", "").split()[::2]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Scalar, Holder] | None = None
        for batch in batches:
            rows = []
            for key, doc, holder_key, other, later, earlier in zip(*batch.columns):
                if held is None or held[0] != holder_key:  # the pairs of a holder stand together
                    held = (holder_key, Holder(*unpacked(earlier.values.to_numpy()), least_words))
                for i, j, a, b in blocks(*unpacked(later.values.to_numpy()), held[1], least_words):
                    rows.append((key.as_py(), doc.as_py(), other.as_py(), i, j, a, b, b - a))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.int64()] * 3 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return both.mapInArrow(match, found)


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """Text without the words of the runs (first, end); what separates words
    goes with the word before it."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, at = [], 0
    for a, b in sorted(runs):
        kept.append(text[at:starts[a]])
        at = max(at, starts[b])
    return "".join([*kept, text[at:]])


def delete_blocks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, all their columns, with the blocks deleted; documents of
    which nothing is left go.  A column n_chars follows the new text."""
    names = documents.columns
    key, gone = fresh(documents, "line_key"), fresh(documents, "line_runs")
    # a document has at most as many runs as lines
    runs = found.groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("first_word", "end_word")).alias(gone))
    tagged = documents.withColumn(key, _key()).join(runs, key, "left")
    same = tagged.filter(F.col(f"`{gone}`").isNull()).select(*[F.col(f"`{n}`") for n in names])
    schema = documents.schema
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t, [(r["first_word"], r["end_word"]) for r in runs])
                     for t, runs in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist())]
            keep = pa.array([i for i, t in enumerate(texts) if t.strip()], pa.int64())
            columns = [c.take(keep) for c in batch.columns[:len(names)]]
            columns[place] = pa.array([t for t in texts if t.strip()], batch.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    cut = tagged.filter(F.col(f"`{gone}`").isNotNull()).select(*[F.col(f"`{n}`") for n in names], f"`{gone}`")
    cut = cut.mapInArrow(run, schema)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return same.unionByName(cut)


def line_dedup(documents: DataFrame, **options) -> DataFrame:
    """The documents without the blocks that earlier documents hold."""
    scratch = Scratch(documents.sparkSession, "lines")
    return delete_blocks(documents, scratch.write(find_blocks(documents, scratch=scratch, **options), "blocks"))
