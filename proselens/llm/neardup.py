"""Near duplicates by MinHash with sequential Bayesian verification (operator 8).

1. Every text becomes its set of word shingles, hashed to 64 bits, and a
   MinHash signature.  Equal sets are one class from here on.
2. Banding proposes pairs of classes.  Small buckets propose all their pairs;
   large ones propose each member with the bucket's smallest.
3. Signatures are compared batch by batch; a pair is pruned as soon as the
   posterior probability that it is similar enough falls under the miss
   probability.
4. Survivors are verified exactly on the full sets, first one partner per
   class, then all that would still join two components.
5. Members of large buckets that are in different components meet in blocks,
   pruned by the same test; what survives is listed per member and block, not
   per pair, and verified block by block on the full sets.  So nothing is
   capped, no task holds a whole bucket, and no row is made per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import Scratch, fresh, join_on_hot_key, pick, ship
from proselens.llm.components import components, extended, with_components

BANDS, ROWS = 30, 5
BATCH = 30
MISS = 1e-6
# Buckets of up to so many classes propose all their pairs.
SMALL_BUCKET = 12
# Members per block when the members of a large bucket meet.
BLOCK = 2048
# Bytes of shingle sets that a block holds, on the mean of its members.
BLOCK_BYTES = 64 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_CHUNK = 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _powers(k: int) -> np.ndarray:
    return _mix(np.arange(1, k + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; ASCII
    letters lowered, words between ASCII white space; a shorter text is one
    shingle, an empty one none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    p = _powers(max(k, len(w) if len(w) < k else k))
    if len(w) < k:
        return _mix(np.array([(w * p[:len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h += w[i:len(w) - k + 1 + i] * p[i]
    return np.unique(_mix(h))


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    a = _mix(np.arange(1, count + 1, dtype=np.uint64) * _MIX[1]) | np.uint64(1)
    return a, _mix(np.arange(1, count + 1, dtype=np.uint64) * _MIX[2])


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(sets, count) 32-bit minima; no set is empty."""
    a, b = permutations(count)
    out = np.empty((len(sets), count), np.uint64)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= _CHUNK):
            size += len(sets[end])
            end += 1
        x = sets[start] if end == start + 1 else np.concatenate(sets[start:end])
        at = np.cumsum([0, *(len(s) for s in sets[start:end - 1])])
        for i in range(count):
            out[start:end, i] = np.minimum.reduceat(x * a[i] + b[i], at)
        start = end
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit bucket keys, different for every band."""
    s = sig[:, :bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    h = (s * _powers(rows)).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _MIX[0]
    return _mix(h).view(np.int64)


def least_matches(count: int, batch: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """After n compared bytes (multiples of ``batch``): the fewest matches for
    which the posterior, from a uniform prior, still gives the pair at least
    probability ``miss`` of reaching the similarity."""
    t = percent / 100
    t += (1 - t) / 256  # one byte of each minimum is kept: others agree by chance
    out = []
    for n in [*range(batch, count, batch), count]:
        # P(Beta(m + 1, n - m + 1) >= t) = P(Bin(n + 1, t) <= m)
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                              + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
        out.append((n, m))
    return out


def survives(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of byte signatures that no batch prunes, and their matches."""
    live = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    done = 0
    for n, least in limits:
        matches[live] += (a[live, done:n] == b[live, done:n]).sum(axis=1, dtype=np.int32)
        live = live[matches[live] >= least]
        done = n
    return live, matches[live]


def _sketch(documents: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    count = bands * rows
    schema = "doc_id long, n long, digest binary, sig binary, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                sets = [shingles(t, k) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full], count)
                keys = band_keys(sig, bands, rows) if full else []
                small = sig.astype(np.uint8)
                digest, sigs, key = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for j, i in enumerate(full):
                    digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    sigs[i], key[i] = small[j].tobytes(), keys[j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()), pa.array(key, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "digest", "sig", "keys"])

    return pick(documents, "doc_id", "text").mapInArrow(run, schema)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _prune(pairs: DataFrame, classes: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """(a, b) -> the pairs that survive the signature test, with matches."""
    sig = classes.select("cls", "sig")
    both = (pairs.join(sig.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
            .join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a").select("a", "b", "sa", "sb"))
    width = limits[-1][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                live, m = survives(_bytes(x.column(2), width), _bytes(x.column(3), width), limits)
                at = pa.array(live)
                yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at), pa.array(m)],
                                                 names=["a", "b", "m"])

    return both.mapInArrow(run, "a long, b long, m int")


def _sets(nodes: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of the named documents, from their whole texts.  The
    names are no bounded set: they are shuffled to the texts, at any size."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([shingles(t, k).tobytes() for t in
                                                batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())],
                    names=["cls", "shingles"])

    # rows that share an id are one document: each of them may hold the link
    texts = pick(documents, "doc_id", "text").withColumnRenamed("doc_id", "cls").join(nodes.hint("merge"), "cls")
    return texts.mapInArrow(make, "cls long, shingles binary")


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s) or 100 * len(s) < percent * len(t):
        return False
    common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * common >= percent * (len(s) + len(t) - common)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    joined = (pairs.select("a", "b").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
              .join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
              .select("a", "b", "sa", "sb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = pa.array([i for i, (p, q) in enumerate(zip(x.column(2), x.column(3)))
                           if linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64),
                                     percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at)], names=["a", "b"])

    return joined.mapInArrow(check, "a long, b long").distinct()


def _blocks(name: str, size: int) -> Column:
    return F.expr(f"cast(ceil({name} / {size}) as int)")


def _blocks_of_sets(rows: str, shingles: str) -> Column:
    """Blocks bounded in rows and in the bytes of their sets, eight a shingle."""
    return F.greatest(_blocks(rows, BLOCK), _blocks(f"8 * {shingles}", BLOCK_BYTES), F.lit(1))


def _meet(hot: DataFrame, classes: DataFrame, comp: DataFrame, limits: list[tuple[int, int]], percent: int,
          scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidates between members of large buckets in different components.

    Those outside a bucket's commonest component meet every block of its
    members, and the signature test prunes.  What survives is never a row per
    pair: one row lists a member's candidates within a home block.  ``home``
    is the commonest component of one of a member's buckets, so that near
    copies share few home blocks.  Returns the lists (home, y, x, cls,
    others) and the members that occur in one: (home, y, cls, xs), xs the
    number of x blocks of the home.
    """
    side = comp.select(F.col("node").alias("cls"), "component")
    members = scratch.write(
        hot.join(side, "cls", "left").select("bkey", "cls", "n", "cnt", F.coalesce("component", "cls").alias("component")),
        "members")
    sizes = members.groupBy("bkey", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = scratch.write(
        sizes.groupBy("bkey").agg(F.max_by("component", F.struct("c", "component")).alias("main"),
                                  F.count(F.lit(1)).alias("comps"), F.sum("c").alias("_n")).filter("comps > 1"), "mixed")
    total = mixed.agg(F.sum("_n")).first()[0] or 0
    rows = join_on_hot_key(members, mixed, "bkey", total=total)
    homes = scratch.write(rows.groupBy("cls").agg(F.min("main").alias("home"),
                                                  F.max((F.col("component") != F.col("main")).cast("int")).alias("out"),
                                                  F.first("n").alias("n")), "homes")
    counts = homes.groupBy("home").agg(F.count(F.lit(1)).alias("_n"), F.sum("out").alias("outs"), F.sum("n").alias("_all"),
                                       F.sum(F.col("n") * F.col("out")).alias("_outs"))
    placed = join_on_hot_key(homes, counts, "home", total=homes.count()).select(
        "cls", "home", F.expr("xxhash64(cls)").alias("at"), _blocks_of_sets("_n", "_all").alias("ys"),
        _blocks_of_sets("outs", "_outs").alias("xs"))
    placed = placed.select("cls", "home", F.expr("cast(pmod(at, ys) as int)").alias("y"), "xs")
    placed = scratch.write(placed, "placed")
    rows = (rows.join(placed, "cls").join(classes.select("cls", "sig"), "cls")
            .withColumn("parts", _blocks("cnt", BLOCK))
            .withColumn("part", F.expr("cast(pmod(xxhash64(cls, 5), parts) as int)")))
    rows = scratch.write(rows, "meeting")
    every = F.explode(F.expr("sequence(0, parts - 1)"))
    left = rows.select("bkey", F.col("part").alias("p"), every.alias("q"), "cls", "n", "component", "sig", "home", "y", "xs")
    outside = scratch.read("meeting", rows.schema).filter("component <> main")
    right = outside.select("bkey", every.alias("p"), F.col("part").alias("q"), "cls", "n", "component", "sig")
    width = limits[-1][0]

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """A member and the outsider it survived against: the list stands in
        the member's home block, for the outsider."""
        found = []
        if len(p) and len(q):
            sp, sq = (np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(-1, width) for f in (p, q))
            ids, comps, ns, homes_, ys, xs = (p[c].to_numpy() for c in ("cls", "component", "n", "home", "y", "xs"))
            for i, (cls, component, n) in enumerate(zip(q["cls"], q["component"], q["n"])):
                some = np.flatnonzero((comps != component) & (100 * np.minimum(ns, n) >= percent * np.maximum(ns, n)))
                live, _ = survives(sp[some], np.broadcast_to(sq[i], (len(some), width)), limits)
                hit = some[live]
                for home, y in {(h, y) for h, y in zip(homes_[hit].tolist(), ys[hit].tolist())}:
                    here = hit[(homes_[hit] == home) & (ys[hit] == y)]
                    # the outsider's place among the x blocks of that home
                    found.append((home, y, int(cls) % int(xs[here[0]]), int(cls), int(component), ids[here].tolist()))
        return pd.DataFrame(found, columns=["home", "y", "x", "cls", "component", "others"])

    key = ["bkey", "p", "q"]
    lists = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        run, "home long, y int, x int, cls long, component long, others array<long>")
    members = rows.select("home", "y", "xs", "cls", "component").distinct()
    return scratch.write(lists, "lists"), members


def _verify_lists(lists: DataFrame, members: DataFrame, sets: DataFrame, same_sets: DataFrame,
                  percent: int) -> DataFrame:
    """Links (a, b) of the lists, exact on full sets (the same table, read twice).  A member that is linked
    to a component needs no second link to it."""
    left = (members.join(sets, "cls").select("home", "y", F.explode(F.expr("sequence(0, xs - 1)")).alias("x"), "cls",
                                             "component", "shingles"))
    right = lists.select("home", "y", "x", "cls", "component", "others").join(same_sets, "cls")
    schema = "a long, b long"

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        theirs: dict[int, list] = {}
        for cls, raw in zip(p["cls"], p["shingles"]):
            theirs.setdefault(cls, []).append(np.frombuffer(raw, np.uint64))
        comps = dict(zip(p["cls"], p["component"]))
        found, joined, tested = [], set(), set()
        for cls, others, raw in zip(q["cls"], q["others"], q["shingles"]):
            mine = np.frombuffer(raw, np.uint64)
            for o in others.tolist():
                if (cls, comps[o]) in joined or (cls, o, raw) in tested:
                    continue
                tested.add((cls, o, raw))
                if any(linked(mine, t, percent) for t in theirs[o]):
                    joined.add((cls, comps[o]))
                    found.append((min(cls, o), max(cls, o)))
        return pd.DataFrame(found, columns=["a", "b"])

    key = ["home", "y", "x"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema)


def drop_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """The documents, all their columns, without those that a component's
    smallest doc_id stands for.  Of rows that share an id one stays (the
    smallest text hash); rows without an id stay."""
    judged = near_duplicates(documents, **options)
    names = [F.col(f"`{c}`") for c in documents.columns]
    key = fresh(documents, "near_key")
    tagged = documents.withColumn(key, F.col("`doc_id`"))
    gone = judged.filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    many = (pick(documents, "doc_id").filter("doc_id is not null").groupBy(F.col("doc_id").alias(key))
            .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key))
    left = tagged.join(gone, key, "left_anti")
    single = left.join(many, key, "left_anti").select(*names)
    repeated = (left.join(many, key, "left_semi").groupBy(key)
                .agg(F.min_by(F.struct(*names), F.xxhash64("`text`")).alias("row")).select("row.*"))
    return single.unionByName(repeated)


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    miss: float = MISS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; ``component_id`` is the smallest doc_id reachable and
    ``kept`` marks it.  Empty and null texts are linked with nothing.  Rows
    that share an id are one document; a row without an id is linked with
    nothing, has no component and is kept.  An empty table gives no rows;
    other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neardup")
    limits = least_matches(bands * rows, BATCH, percent, miss)
    sketch = scratch.write(_sketch(documents, k, bands, rows), "sketch")
    linked = sketch.filter("doc_id is not null and n > 0")
    classes = scratch.write(
        linked.groupBy("digest").agg(F.min("doc_id").alias("cls"), F.first("n").alias("n"), F.first("sig").alias("sig"),
                                     F.first("keys").alias("keys"), F.count(F.lit(1)).alias("_n")), "classes")
    # rows that share an id but not a set: links between their classes
    same = (linked.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets"))
            .filter("sets > 1").select("doc_id"))
    same = (linked.join(same, "doc_id", "left_semi").select("doc_id", "digest").distinct()
            .join(classes.select("digest", "cls"), "digest").select(F.col("cls").alias("a"), F.col("doc_id").alias("b")))

    banded = classes.select(F.explode("keys").alias("bkey"), "cls", "n")
    buckets = scratch.write(banded.groupBy("bkey").agg(F.min("cls").alias("rep"), F.count(F.lit(1)).alias("cnt"))
                            .filter("cnt > 1"), "buckets")
    total = buckets.agg(F.sum("cnt")).first()[0] or 0
    members = scratch.write(
        join_on_hot_key(banded, buckets, "bkey", n="cnt", total=total).select("bkey", "cls", "n", "rep", "cnt"), "banded")
    small, hot = members.filter(F.col("cnt") <= small_bucket), members.filter(F.col("cnt") > small_bucket)
    fits = F.expr(f"100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n)")
    both = (small.alias("p").join(small.alias("q"), (F.col("p.bkey") == F.col("q.bkey"))
                                  & (F.col("p.cls") < F.col("q.cls")) & fits)
            .select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b")))
    star = hot.filter("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b"))
    pairs = both.unionByName(star).distinct()
    survivors = scratch.write(_prune(pairs, classes, limits), "survivors")

    # one partner each, the likeliest
    first = survivors.groupBy("b").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a")).select("a", "b")
    first = scratch.write(first, "first")
    sets = scratch.write(_sets(_ends(first), documents, k), "first-sets")
    links = scratch.write(_verify(first, sets, percent).unionByName(
        same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "links1")
    comp = scratch.write(components(links, scratch, "c1-"), "comp1")
    scratch.drop("first-sets")
    # then all that would still join two components, from small and large buckets
    rest = with_components(survivors.select("a", "b").join(first, ["a", "b"], "left_anti"), comp).filter("ca <> cb")
    rest = scratch.write(rest.select("a", "b"), "rest")
    lists, members = _meet(hot, classes, comp, limits, percent, scratch)
    nodes = _ends(rest).unionByName(lists.select("cls")).unionByName(members.select("cls")).distinct()
    sets = scratch.write(_sets(nodes, documents, k), "rest-sets")
    again = scratch.read("rest-sets", sets.schema)
    more = _verify(rest, sets, percent).unionByName(_verify_lists(lists, members, sets, again, percent))
    comp = extended(comp, scratch.write(more, "links2"), scratch, "c2-")

    named = scratch.write(classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
                          .select("digest", "_n", F.coalesce("component", "cls").alias("component_id")), "named")
    total = named.agg(F.sum("_n")).first()[0] or 0
    some = join_on_hot_key(linked.select("doc_id", "n", "digest"), named, "digest", total=total)
    none = sketch.filter("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (some.select("doc_id", "n", "component_id").unionByName(none)
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
