"""Text similarity on exact term counts (the default text encoder).

A text becomes the bag of its lower-cased whitespace tokens; similarity is
the cosine of the two count vectors.  Dot products and squared norms are
integers, so every engine gets the same value up to one sqrt and one
division.

Each text is one row throughout: a row meets the one reference row that it
points to by an equi-join on the reference key, and the measure is computed on
the joined row from an Arrow batch.  Tokens never move.  A set of references
that every text is held against (gold texts) is dealt to blocks of bounded
size, which meet shards of texts in tasks, where an inverted index gives the
best one.

Other encoders plug in through ``proselens.operators.encoders``.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselens.operators.common import by_key, ship_package, spread_by

# Bytes of reference texts and of texts that a task holds at a time.
REFERENCE_BYTES = 32 << 20
SHARD_BYTES = 64 << 20


def bag(text: str | None) -> Counter:
    return Counter((text or "").lower().split())


def norm2(b: Counter) -> int:
    return sum(v * v for v in b.values())


def dot(a: Counter, b: Counter) -> int:
    if len(b) < len(a):
        a, b = b, a
    return sum(v * b[k] for k, v in a.items() if k in b)


def cosine_from_parts(d: int, n2a: int, n2b: int) -> float:
    """dot / (|a| |b|); zero norms -> 0.0."""
    return d / (math.sqrt(n2a) * math.sqrt(n2b)) if n2a and n2b else 0.0


def _per_row(joined: DataFrame, key: str, fields: list[T.StructField], fn: Callable[[], Callable]) -> DataFrame:
    """Append ``fields`` computed by ``fn()(text, reference)`` to the key of
    every row of (key, text, reference).  The rows stay where they are: those
    of a join lie in its partitions, and its references would be copied once
    per row by another shuffle."""
    schema = T.StructType([joined.schema[key], *fields])
    ship_package(joined.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = fn()
        kinds = {T.DoubleType(): pa.float64(), T.LongType(): pa.int64()}
        for batch in batches:
            rows = [measure(t, r) for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, kinds[f.dataType]) for c, f in zip(columns, fields)]],
                names=[key, *[f.name for f in fields]])

    return joined.mapInArrow(run, schema)


def _pointed_to(rows: DataFrame, key: str, text_col: str, ref: DataFrame, ref_key: str, col: str, out: str) -> DataFrame:
    """(key, _t, out): each row's text with what the one reference row that it
    points to holds in ``col``."""
    theirs = ref.select(ref_key, F.col(col).alias(out))
    return rows.select(key, ref_key, F.col(text_col).alias("_t")).join(by_key(theirs), ref_key, "left").select(key, "_t", out)


def remembered(make: Callable) -> Callable:
    """``make`` of the last argument again and again costs one call: rows of a
    reference stand together after the join."""
    last: list = [None, None]

    def get(x):
        if last[1] is None or x != last[0]:
            last[:] = [x, make(x)]
        return last[1]

    return get


def paired_cosine(rows: DataFrame, key: str, text_col: str, ref: DataFrame, ref_key: str,
                  ref_text_col: str, out: str) -> DataFrame:
    """Cosine of each row's text with the one reference text it points to; 0.0
    without one.

    ``rows`` has (key, ref_key, text); ``ref`` has (ref_key unique, text).
    Used for attribute alignment (reference = the product's attribute text)
    and for paired gold similarity.
    """
    return _own_cosine(_pointed_to(rows, key, text_col, ref, ref_key, ref_text_col, "_r"), key, out)


def own_cosine(rows: DataFrame, key: str, text_col: str, other_col: str, out: str) -> DataFrame:
    """Cosine of two texts of the same row (a row's own ``gold_text``)."""
    both = rows.select(key, F.col(text_col).alias("_t"), F.col(other_col).alias("_r"))
    return _own_cosine(spread_by(both, key), key, out)


def _own_cosine(both: DataFrame, key: str, out: str) -> DataFrame:
    def fn():
        other = remembered(lambda r: (b := bag(r), norm2(b)))

        def measure(text, ref):
            a, (b, n) = bag(text), other(ref)
            return (cosine_from_parts(dot(a, b), norm2(a), n),)
        return measure

    return _per_row(both, key, [T.StructField(out, T.DoubleType())], fn)


def max_reference_similarity(rows: DataFrame, key: str, text_col: str, refs: DataFrame | None,
                             ref_key: str, ref_text_col: str, out: str = "sbert",
                             reference_bytes: int = REFERENCE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Best cosine of each text to any reference (gold) text; 0.0 without any.

    Distinct references are dealt to blocks of about ``reference_bytes`` and
    texts to shards of about ``shard_bytes``; a task holds one of each, and
    only each text's best leaves it.  Nothing passes through the driver.
    """
    if refs is None:
        return rows.select(key, F.lit(0.0).alias(out))
    ship_package(rows.sparkSession)
    base = rows.select(key, F.col(text_col).alias("_t"))
    texts = refs.select(F.col(ref_text_col).alias("_g")).filter(F.col("_g").isNotNull()).distinct()
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("_g")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_bytes // reference_bytes))
    size = base.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0]
    # a shard is a task's texts of about shard_bytes; each task reads one block
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-size // shard_bytes))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select(key, "_t", deal(key, shards).alias("_shard"), every(blocks).alias("_block"))
    right = texts.select("_g", deal("_g", blocks).alias("_block"), every(shards).alias("_shard"))
    schema = T.StructType([rows.schema[key], T.StructField(out, T.DoubleType())])

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        measure = _best_of(q.column("_g").to_pylist())
        return pa.table({key: p.column(key), out: pa.array([measure(t.as_py()) for t in p.column("_t")], pa.float64())})

    found = left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInArrow(run, schema)
    return found if blocks == 1 else found.groupBy(key).agg(F.max(out).alias(out))


def _best_of(references: list[str]) -> Callable[[str | None], float]:
    """Best cosine of a text with any of the references, by an inverted index."""
    bags = [bag(g) for g in references]
    norms = np.array([math.sqrt(norm2(b)) for b in bags])
    index = defaultdict(list)
    for n, b in enumerate(bags):
        for token, tf in b.items():
            index[token].append((n, tf))
    postings = {t: (np.array([n for n, _ in p]), np.array([tf for _, tf in p], np.int64)) for t, p in index.items()}

    def measure(text: str | None) -> float:
        a = bag(text)
        dots = np.zeros(len(bags), np.int64)
        for token, tf in a.items():
            if token in postings:
                at, tfs = postings[token]
                dots[at] += tf * tfs
        hit = np.flatnonzero(dots)
        return float((dots[hit] / (math.sqrt(norm2(a)) * norms[hit])).max()) if len(hit) else 0.0

    return measure


def feature_coverage(rows: DataFrame, key: str, text_col: str, refs: DataFrame, ref_key: str,
                     features_col: str, threshold: float, out: str = "semantic_feature_coverage") -> DataFrame:
    """A17 (A22, J6): share of a row's features whose cosine with the text
    reaches ``threshold``; repeated features count every time.

    ``rows`` = (key, ref_key, text), ``refs`` = (ref_key unique, features
    array): a text is scored against the feature list of the product it
    belongs to, never against all features.  Within a worker each distinct
    feature text is tokenised once (A22); features without a token do not
    count.  Output: (key, n_features, n_covered, out).
    """
    joined = _pointed_to(rows, key, text_col, refs, ref_key, features_col, "_f")
    fields = [T.StructField("n_features", T.LongType()), T.StructField("n_covered", T.LongType()),
              T.StructField(out, T.DoubleType())]

    def fn():
        known: dict[str, tuple[Counter, int]] = {}

        def encoded(feature):
            if feature not in known:
                if len(known) >= 100_000:  # bounds the worker's memory only
                    known.clear()
                b = bag(feature)
                known[feature] = (b, norm2(b))
            return known[feature]

        def measure(text, features):
            a = bag(text)
            n2 = norm2(a)
            some = [e for e in (encoded(f) for f in features or [] if f is not None) if e[1]]
            covered = sum(cosine_from_parts(dot(a, b), n2, n) >= threshold for b, n in some if n2)
            return len(some), covered, covered / len(some) if some else 0.0
        return measure

    return _per_row(joined, key, fields, fn)
