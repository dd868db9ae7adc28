"""Toxicity by weak supervision (operator 7).

Voters: a hand-made lexicon, text patterns, and words and word beginnings that
a bounded sample of labelled documents holds much more often in one class.  A
generative label model (EM over the voters' firing rates per class, the given
label being one more fallible voter) estimates their accuracies; conditional
correlations between voters, estimated under its posterior, temper what each
adds, so that ten forms of one signal do not count ten times.  A linear
classifier trained on the posterior labels then scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselens.llm.common import fresh, pick, ship

# Labelled documents that the models learn from, at most.
SAMPLE_ROWS = 12_000
# Mined voters, and features of the linear classifier.
VOTERS, FEATURES = 200, 1000
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6)
LEXICON = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
           "dumb", "imbecile", "hate", "ugly", "filth", "vermin", "jerk", "fool")
# name -> pattern over the whole text
PATTERNS = {
    "!shout": re.compile(r"(?:\b[A-Z]{3,}\b\W+){4}"),
    "!marks": re.compile(r"!{3,}|[!?]{4,}"),
    "!insult": re.compile(r"\byou(?:'re| are)? (?:an? |such )?(?:\w+ )?(?:idiot|moron|loser|clown|fool)", re.I),
    "!masked": re.compile(r"\b\w+[*@#$]{2,}\w*\b"),
}
_WORD = re.compile(r"\w+")
_MEMO_WORDS = 100_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def word_features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def text_features(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        out.update(word_features(w))
    out.update(name for name, rx in PATTERNS.items() if rx.search(text))
    return out


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float]
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def known(self, text: str) -> set[str]:
        memo, weights, found = self.memo, self.weights, set()
        for w in set(_WORD.findall(text.lower())):
            hit = memo.get(w)
            if hit is None:
                if len(memo) >= _MEMO_WORDS:
                    memo.clear()
                hit = memo[w] = tuple(f for f in word_features(w) if f in weights)
            found.update(hit)
        found.update(name for name, rx in PATTERNS.items() if name in weights and rx.search(text))
        return found

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(self.known(text)))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 per row, and the weight of each voter.

    ``votes``: rows x voters, 1 where a voter fires; ``given``: the labels, the
    last voter.  EM alternates firing rates per class with posteriors; after
    each round a voter's log-likelihood ratio is divided by one plus the sum
    of its positive conditional correlations with the other voters.
    """
    v = np.column_stack([votes, given]).astype(np.float32)
    q = np.where(given > 0, 0.97, 0.03).astype(np.float64)
    temper = np.ones(v.shape[1])
    for turn in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        hi = (q @ v + 1) / (q.sum() + 2)
        lo = ((1 - q) @ v + 1) / ((1 - q).sum() + 2)
        if turn in (0, rounds // 2):
            mean = np.outer(q, hi).astype(np.float32) + np.outer(1 - q, lo).astype(np.float32)
            rest = v - mean
            cov = rest.T @ rest
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            corr = np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(corr, 0)
            corr[corr < 0.1] = 0
            temper = 1 / (1 + corr.sum(axis=1))
            temper[-1] = 1  # the given label is no form of any text signal
        on, off = np.log(hi / lo) * temper, np.log((1 - hi) / (1 - lo)) * temper
        z = math.log(prior / (1 - prior)) + v @ on + (1 - v) @ off
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            return new, temper
        q = new
    return q, temper


def linear(x: np.ndarray, target: np.ndarray, l2: float = 0.05, steps: int = 500) -> tuple[float, np.ndarray]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    n, k = x.shape
    w, b = np.zeros(k, np.float32), float(math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    prev_w, prev_b = w.copy(), b
    # Lipschitz bound of the loss from the largest eigenvalue, by power steps
    u = np.ones(k, np.float32)
    for _ in range(12):
        u = x.T @ (x @ u)
        u /= max(float(np.linalg.norm(u)), 1e-9)
    rate = 1 / (0.25 * (float(u @ (x.T @ (x @ u))) + n) + l2)
    for t in range(1, steps + 1):
        m = (t - 1) / (t + 2)
        yw, yb = w + m * (w - prev_w), b + m * (b - prev_b)
        err = 1 / (1 + np.exp(-np.clip(x @ yw + yb, -30, 30))) - target
        prev_w, prev_b = w, b
        w = yw - rate * (x.T @ err.astype(np.float32) + l2 * yw)
        b = yb - rate * float(err.sum())
    return b, w


def _mine(sample: DataFrame, count: int) -> list[str]:
    """Features with the strongest contrast between the classes, from counts
    made in the tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yes, no = Counter(), Counter()
            for text, y in zip(pdf["text"], pdf["y"]):
                (yes if y else no).update(text_features(text))
            names = list(yes.keys() | no.keys())
            yield pd.DataFrame({"feature": names, "yes": [yes[f] for f in names], "no": [no[f] for f in names]})

    total = sample.agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no")).first()
    n1, n0 = float(total["yes"] or 0), float(total["no"] or 0)
    if not n1 or not n0:
        return []
    counts = (sample.mapInPandas(run, "feature string, yes long, no long").groupBy("feature")
              .agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
              .filter(F.col("yes") + F.col("no") >= 3))
    share = (F.col("yes") + F.col("no") + 1) / (n1 + n0 + 2)
    z = (F.col("yes") / n1 - F.col("no") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    ranked = counts.withColumn("z", z).filter("z > 1 or z < -3")
    # strongest for class 1 first; the cut is the model's documented size
    top = ranked.orderBy(F.desc("z"), "feature").limit(count).select("feature", "z")
    return [r["feature"] for r in top.collect()]


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          features: int = FEATURES) -> ToxicityModel:
    """Model from the labelled documents outside the held-out third.

    Null labels and null ids take no part; of repeated labels of a document
    the larger counts, of its repeated rows the least text.  Without any usable label the lexicon alone decides.
    """
    ship(documents.sparkSession)
    known = (pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null")
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # one row per document, however often its id is repeated: its least text
    sample = (pick(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
              .groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))
              .select("text", "y"))
    vocabulary = _mine(sample, features)
    words = ["=" + w for w in LEXICON]
    if not vocabulary:
        return ToxicityModel(-3.0, {w: 4.0 for w in words})
    names = list(dict.fromkeys([*vocabulary, *words, *PATTERNS]))
    place = {f: i for i, f in enumerate(names)}
    probe = ToxicityModel(0.0, dict.fromkeys(names, 0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"on": [sorted(place[f] for f in probe.known(t)) for t in pdf["text"]], "y": pdf["y"]})

    rows = sample.mapInPandas(run, "on array<int>, y int").toPandas()  # at most sample_rows short lists
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, on in enumerate(rows["on"]):
        x[i, np.asarray(on, dtype=int)] = 1
    y = rows["y"].to_numpy(np.float64)
    voters = [place[f] for f in dict.fromkeys([*vocabulary[:VOTERS], *words, *PATTERNS])]
    posterior, _ = label_model(x[:, voters], y)
    bias, weights = linear(x, posterior)
    return ToxicityModel(bias, {f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-6})


def drop_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all their columns, that are not predicted toxic."""
    score, predicted = fresh(documents, "score"), fresh(documents, "predicted")
    return (score_documents(documents, model, threshold, documents.columns, score, predicted)
            .filter(F.col(f"`{predicted}`") == 0).drop(score, predicted))


def score_documents(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD,
                    keep: list[str] | None = None, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``keep`` columns (default doc_id) with the score and the prediction.

    Null texts count as empty and get the model's base score; repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    ship(documents.sparkSession)
    names = keep or ["doc_id"]
    rows = pick(documents, *dict.fromkeys([*names, "text"]))
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField(score, T.DoubleType()),
                           T.StructField(predicted, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column("text")]
            columns = [batch.column(n) for n in names]
            columns += [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, score, predicted])

    return rows.mapInArrow(run, schema)
