"""Operator 11 against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.conftest import with_clashes

from proselens.llm import ranked

ITEM_SCHEMA = "item_id long, text string"


def terms(text):
    return re.findall(ranked.TERM, (text or "").translate(str.maketrans(ranked.UPPER, ranked.LOWER)))


def direct(docs, items, k=50):
    rows = [(d, Counter(w), len(w)) for d, t in docs if (w := terms(t))]
    total, count = sum(n for *_, n in rows), len(rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, c, n in rows:
            m = 50 + (50 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, math.inf if d is None else d, d))
        scored.sort(key=lambda r: r[:2])
        out += [(i, r + 1, d, -x) for r, (x, _, d) in enumerate(scored[:k])]
    return by_item(out)


def by_item(rows):
    return sorted(map(tuple, rows), key=lambda r: (repr(r[0]), r[1]))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "été", "A", "the"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, None if i % 97 == 0 else " ,\n".join(rng.choices(words, weight, k=rng.choice([0, 1, 3, 20, 200]))))
            for i in range(n)]
    docs += docs[100:140] + [(None, docs[5][1])] * 2  # repeated rows, null ids
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(25)]
    return docs, items + [(3, "w1 W2"), (None, "the a É"), (77, None), (78, "nothing like it")]


@pytest.mark.parametrize("settings", [{}, {"shard_postings": 300}, {"k": 3, "shard_postings": 1500},
                                      {"block_bytes": 600, "shard_postings": 2000, "step": 3, "least_sample": 30}])
def test_equals_scoring_all(spark, settings):
    docs, items = corpus(11, 500)
    found = ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                          with_clashes(spark.createDataFrame(items, ITEM_SCHEMA)), **settings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_item(found.collect()) == direct(docs, items, settings.get("k", 50))


def test_ties_go_to_smaller_ids_across_tasks(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(i, "other text") for i in range(400, 500)]
    found = ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
                          spark.createDataFrame([(1, "same")], ITEM_SCHEMA), shard_postings=50)
    assert [(r.rank, r.doc_id) for r in found.orderBy("rank").collect()] == [(i, i) for i in range(1, 51)]


def test_range_maxima_are_upper_bounds_and_tight():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 5, 200)
    terms_ = np.concatenate([rng.choice(5, n, replace=False) for n in lengths]).astype(np.int32)
    tfs = rng.integers(1, 9, len(terms_)).astype(np.int32)
    s = ranked.Shard(np.arange(200), rng.integers(5, 90, 200), lengths, terms_, tfs,
                     np.array([900, 70, 4000, 1, 250]), 200, 9000)
    for _ in range(300):
        t = rng.integers(5)  # a range stays within one list
        lo, hi = np.sort(rng.integers(s.starts[t], s.ends[t] + 1, 2))
        got = float(s.maxima(np.array([lo]), np.array([hi]))[0])
        want = int(s.impact[lo:hi].max(initial=0))
        assert want <= got <= want * (1 + 1e-6) + 1e-6


def test_long_texts_are_split_at_separators(monkeypatch):
    monkeypatch.setattr(ranked, "STRETCH", 7)
    text = "alpha beta,alpha gamma ünder " * 40
    known = {b"alpha": 0, "ünder".encode(): 1, b"none": 2}
    assert ranked.count_terms(text.encode(), known) == (200, {0: 80, 1: 40})


def test_odd_tables(odd_documents, odd_rows, no_documents, spark):
    items = [(1, odd_rows[0][1][:200]), (2, "a"), (None, "one b"), (3, "")]
    i = spark.createDataFrame(items, ITEM_SCHEMA)
    assert by_item(ranked.search(odd_documents, i).collect()) == direct([r[:2] for r in odd_rows], items)
    assert ranked.search(no_documents, i).count() == 0
    assert ranked.search(odd_documents, i.limit(0)).count() == 0
    assert ranked.search(spark.createDataFrame([(1, None), (2, " . ")], "doc_id long, text string"), i).count() == 0
