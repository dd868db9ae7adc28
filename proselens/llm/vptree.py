"""Nearest neighbours by vantage-point trees per shard (operator 3).

Largest inner products become nearest neighbours once every vector gets the
component sqrt(M^2 - |x|^2), M being the largest norm; queries get a zero
there.  Rows are hashed to shards, each shard's tree is built once and written;
queries are hashed to blocks, and each (shard, block) task takes its queries
down the tree together, nearest branch first, leaving out a branch when
``factor`` times its triangle-inequality bound exceeds the distance of the
query's k-th best so far.  Factor one is exact; larger factors skip more.  A
bounded sample of the index gives every query its first bound.  Scores of what
is found are summed anew in double precision, component by component, on the
original vectors.  Where the largest squared norm leaves the range in which
squared distances mean something in doubles, shards are scanned instead.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proselens.llm.common import Scratch, pick, ship

SHARD_ROWS = 8192
QUERY_BLOCK = 8192
# A written tree holds at most about this much.
SHARD_BYTES = 32 << 20
# Queries that go down a tree together.
DESCENT = 1024
LEAF_ROWS = 128
# Rows whose scores give each query a first bound.
SAMPLE_ROWS = 2048
_SLACK = 1e-9
# Squared norms between which trees are used.
LEAST_NORM2, MOST_NORM2 = 1e-200, 1e300


class Tree:
    """Vantage-point tree over the rows of ``points``."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.points = points
        self.leaf_rows = leaf_rows
        self.root = self._build(np.arange(len(points))) if len(points) else None

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= self.leaf_rows:
            return ("leaf", rows)
        own = self.points[rows]
        # the row farthest from the first spreads the distances
        vantage = rows[int(np.argmax(((own - own[0]) ** 2).sum(axis=1)))]
        d = np.sqrt(((own - self.points[vantage]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return ("node", self.points[vantage],
                (d[near].min(), d[near].max(), self._build(rows[near])),
                (d[far].min(), d[far].max(), self._build(rows[far])))


def sequential_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component on."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def index_shard(vectors: np.ndarray, ids: np.ndarray, k: int, norm2: float) -> bytes:
    """Tree of a shard, ready to be written.  Equal vectors are one point; of
    their ids only the k + 1 smallest can be among the k best."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    vectors, ids = vectors[order], ids[order]
    again = np.zeros(len(ids), dtype=bool)  # repeated rows are hashed to one shard
    again[1:] = (ids[1:] == ids[:-1]) & (vectors[1:] == vectors[:-1]).all(axis=1)
    vectors, ids = vectors[~again], ids[~again]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    starts = np.flatnonzero(fresh)
    ends = np.minimum(np.append(starts[1:], len(ids)), starts + k + 1)
    points = vectors[starts]
    if not tree_fits(norm2):
        return pickle.dumps((ids, points, starts, ends, None))
    lift = np.sqrt(np.maximum(norm2 - (points ** 2).sum(axis=1), 0))
    return pickle.dumps((ids, points, starts, ends, Tree(np.column_stack([points, lift])).root))


def tree_fits(norm2: float) -> bool:
    """Whether squared distances neither overflow nor vanish in doubles."""
    return LEAST_NORM2 < norm2 < MOST_NORM2


def _best(q: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query: a score that is no number counts as the
    largest, as Spark sorts it; ties go to the smaller id."""
    no_number = np.isnan(score)
    order = np.lexsort((vec, -np.where(no_number, np.inf, score), ~no_number, q))
    q, vec, score = q[order], vec[order], score[order]
    top = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[top], vec[top], score[top]


def scan_shard(index: tuple, queries: np.ndarray, query_ids: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``search_shard``, without a tree: every score of the shard."""
    ids, points, starts, ends, _ = index
    rows = np.repeat(np.arange(len(points)), ends - starts)
    vec = ids[np.repeat(starts, ends - starts) + np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")]
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        for i, (query, own) in enumerate(zip(queries, query_ids)):
            score = sequential_scores(np.broadcast_to(query, points.shape), points)[rows]
            other = vec != own
            out.append(_best(np.full(int(other.sum()), i), vec[other], score[other], k))
    return tuple(np.concatenate(x) for x in zip(*out))


def search_shard(index: tuple, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int,
                 norm2: float, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of up to ``k`` best rows of an indexed
    shard for each query, its own id left out.  ``bounds``: scores that a
    query's k-th best reaches at least.  Rounding is allowed for in proportion
    to the largest norm."""
    ids, points, starts, ends, root = index
    lifted = np.column_stack([queries, np.zeros(len(queries))])
    q2 = (queries ** 2).sum(axis=1)
    best = np.full((len(queries), k + 1), -np.inf)  # the query's own row may be among them
    least = bounds.copy()
    found_q, found_p, found_s = [], [], []
    slack, slack_r = _SLACK * norm2, _SLACK * np.sqrt(norm2)

    def radius(q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(q2[q] + norm2 - 2 * least[q], 0))

    def visit(node: tuple, q: np.ndarray) -> None:
        if not len(q):
            return
        if node[0] == "leaf":
            rows = node[1]
            s = queries[q] @ points[rows].T
            passed = s >= (least[q] - slack)[:, None]
            hit = passed.any(axis=1)
            if not hit.any():
                return
            s, passed, q = s[hit], passed[hit], q[hit]
            a, b = np.nonzero(passed)
            found_q.append(q[a])
            found_p.append(rows[b])
            found_s.append(s[a, b])
            both = np.concatenate([best[q], np.where(passed, s, -np.inf)], axis=1)
            top = -np.partition(-both, k, axis=1)[:, :k + 1]
            best[q] = top
            least[q] = np.maximum(least[q], top.min(axis=1))
            return
        _, vantage, near, far = node
        d = np.sqrt(((lifted[q] - vantage) ** 2).sum(axis=1))
        inner = d <= (near[1] + far[0]) / 2

        def enter(child: tuple, some: np.ndarray, ds: np.ndarray) -> None:
            low, high, below = child
            bound = np.maximum(np.maximum(ds - high, low - ds), 0)
            visit(below, some[bound * factor <= radius(some) * (1 + _SLACK) + slack_r])

        for here, first, second in ((inner, near, far), (~inner, far, near)):
            enter(first, q[here], d[here])
            enter(second, q[here], d[here])

    if root is not None and len(queries):
        visit(root, np.arange(len(queries)))
    if not found_q:
        return np.array([], int), np.array([], np.int64), np.array([])
    fq, fp, fs = (np.concatenate(x) for x in (found_q, found_p, found_s))
    keep = fs >= least[fq] - slack
    fq, fp = fq[keep], fp[keep]
    score = sequential_scores(queries[fq], points[fp])
    copies = (ends - starts)[fp]
    fq, score, at = np.repeat(fq, copies), np.repeat(score, copies), np.repeat(starts[fp], copies)
    at = at + np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
    vec = ids[at]
    other = vec != query_ids[fq]
    return _best(fq[other], vec[other], score[other], k)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: ids and vectors not null, all
    components finite, not all zero, of the table's commonest length (of equal
    counts the shorter)."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (pick(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .filter(~F.coalesce(bad, F.lit(True))).filter(F.exists("v", lambda x: x != 0)))
    width = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.filter(F.size("v") == (width[0]["n"] if width else 0))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS,
            query_block: int = QUERY_BLOCK, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` largest inner
    products over all other rows, ties to the smaller id.

    Rows that ``usable`` leaves out take no part.  Repeated rows of an id
    count once; a query id with several vectors is searched by the smallest.
    Scores are doubles: products beyond their range are infinite, and a sum
    that is no number counts as the largest.  An empty table gives no rows;
    other columns are ignored.
    """
    spark = embeddings.sparkSession
    ship(spark)
    scratch = Scratch(spark, "nearest")
    rows = scratch.write(usable(embeddings).distinct(), "rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
                     F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    queries = scratch.write(rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, norm2 = facts["n"], float(facts["norm2"] or 0) * (1 + 1e-12)
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (8 * (facts["width"] or 1))))
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-queries.count() // query_block))
    sampled = np.zeros((0, 1))
    if tree_fits(norm2):
        sample = (rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
                  .drop_duplicates("vec_id")["v"])
        sampled = np.stack(sample.to_list())

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = index_shard(np.stack(part["v"].to_list()), part["vec_id"].to_numpy(np.int64), k, norm2)
        return pd.DataFrame({"shard": part["shard"].iloc[:1].to_list(), "tree": [tree]})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(left) and len(right):
            index = pickle.loads(left["tree"].iloc[0])
            for a in range(0, len(right), DESCENT):
                some = right.iloc[a:a + DESCENT]
                q, qid = np.stack(some["v"].to_list()), some["vec_id"].to_numpy(np.int64)
                if not tree_fits(norm2):
                    at, vec, score = scan_shard(index, q, qid, k)
                else:
                    bounds = np.full(len(q), -np.inf)
                    if len(sampled) > k + 1:
                        bounds = -np.partition(-(q @ sampled.T), k, axis=1)[:, k]
                    at, vec, score = search_shard(index, q, qid, bounds, k, norm2, factor)
                out.append(pd.DataFrame({"query_id": qid[at], "vec_id": vec, "score": score}))
        return pd.concat(out[1:] or out, ignore_index=True)

    shard = F.expr(f"pmod(xxhash64(vec_id), {shards})").cast("int").alias("shard")
    block = F.expr(f"pmod(xxhash64(vec_id, 7), {blocks})").cast("int").alias("block")
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    trees = scratch.write(rows.select("vec_id", "v", shard).groupBy("shard")
                          .applyInPandas(build, "shard int, tree binary"), "trees")
    index = trees.select("shard", "tree", every(blocks, "block"))
    asked = queries.select("vec_id", "v", block, every(shards, "shard"))
    found = (index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
             .applyInPandas(run, "query_id long, vec_id long, score double"))
    # a score that is no number comes back from pandas as null
    score = F.coalesce("score", F.lit(float("nan")))
    best = found.groupBy("query_id", "vec_id").agg(F.max(score).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
