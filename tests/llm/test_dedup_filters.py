"""Operators 5, 6, 7, 8 and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from llm.conftest import DOC_SCHEMA, prose, with_clashes
from proselens.llm import decontaminate, linededup, neardup, toxicity
from proselens.llm.components import components
from proselens.llm.common import Scratch

ITEMS = "item_id long, text string"


def edit(words, rng, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = "zq" + str(rng.randrange(99))
        elif kind == 1:
            out.insert(i, "zq" + str(rng.randrange(99)))
        elif len(out) > 3:
            del out[i]
    return out


def least_distance(item, words):
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        prev, row = row, [0]
        for j, x in enumerate(item):
            row.append(min(prev[j] + (x != w), prev[j + 1] + 1, row[j] + 1))
        best = min(best, row[-1])
    return best


def test_window_minima_are_those_of_every_window():
    import numpy as np

    values = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 5, 8, 12, 50):
        want = [values[i:i + width].min() for i in range(len(values) - width + 1)]
        assert linededup.window_minima(values, width).tolist() == want


def test_leaks_equal_brute_force(spark, odd_rows):
    rng = random.Random(7)
    items = [(i, prose(100 + i, rng.randint(6, 50))) for i in range(12)] + [(90, None), (91, ""), (92, "two words")]
    docs = [r[:2] for r in odd_rows]
    for k in range(60):
        text = prose(500 + k, 120).split()
        words = items[k % 12][1].split()
        at = rng.randrange(len(text))
        docs.append((1000 + k, " ".join(text[:at] + edit(words, rng, rng.randrange(len(words) // 4 + 1)) + text[at:])))
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in
           decontaminate.find_leaks(df, with_clashes(spark.createDataFrame(items, ITEMS))).collect()}
    want = {}
    for i, t in docs:
        for b, item in items:
            x = decontaminate.words_of(item)
            if x:
                d = least_distance(x, decontaminate.words_of(t))
                if d <= decontaminate.edits(len(x), decontaminate.SHARE):
                    want[i, b] = d
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want) and {k for k, d in want.items() if d == 0} <= set(got)
    assert all(got[k]["distance"] == want[k] for k in got)
    text, item = ({k: decontaminate.words_of(t) for k, t in rows} for rows in (docs, items))
    for (i, b), r in got.items():  # the run itself has that distance, and its first and last word are the item's own
        run = text[i][r["start_word"]:r["end_word"]]
        assert least_distance(item[b], run) == r["distance"]
        assert min(run[0] in item[b], run[-1] in item[b]) and len(run) <= len(item[b]) + r["distance"]


@pytest.mark.parametrize("change,start,end", [(lambda w: w[:10] + ["inserted"] + w[10:], 50, 71),
                                              (lambda w: w[:5] + w[6:14] + w[15:], 50, 68), (lambda w: w, 50, 70)])
def test_leaks_begin_where_the_passage_does(spark, change, start, end):
    item = prose(77, 20)
    words = prose(78, 50).split() + change(item.split()) + prose(79, 50).split()
    row = decontaminate.find_leaks(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"),
                                   spark.createDataFrame([(5, item)], ITEMS)).first()
    assert (row["start_word"], row["end_word"]) == (start, end)


def test_windows_in_chunks_change_nothing(monkeypatch):
    items = decontaminate.Items([(i, prose(200 + i, 30)) for i in range(6)], decontaminate.SHARE, decontaminate.LEAST_WORDS,
                                decontaminate.WALKS, decontaminate.SAMPLES, decontaminate.PLACES)
    texts = [" ".join([prose(300 + i, 20), prose(200 + i % 6, 30), prose(400 + i, 20)]) for i in range(30)]
    want = items.scan(texts)
    assert len(want) >= 30
    monkeypatch.setattr(decontaminate, "_WINDOW_BYTES", 600)
    assert items.scan(texts) == want


def test_short_items_match_word_for_word(spark):
    docs = spark.createDataFrame([(1, "Some TWO words here"), (2, "two other words"), (3, "word"), (4, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two words"), (2, "word"), (3, "!"), (4, None)], ITEMS)
    got = {(r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(1, 1, 1, 3), (3, 2, 0, 1)}
    # too common to reject a document for, unless asked
    assert decontaminate.drop_leaks(docs, bench).count() == 4
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench, least_words=1).collect()} == {2, 4}


def test_leaking_rows_go_block_by_block(spark):
    items = [(i, prose(100 + i, 20)) for i in range(9)]
    docs = with_clashes(spark.createDataFrame([(i, prose(i, 30) + " " + (t if i % 2 else "")) for i, t in items] + [(None, items[3][1])],
                                              "doc_id long, text string"))
    for per_block in (2, 1000):
        kept = decontaminate.drop_leaks(docs, spark.createDataFrame(items, ITEMS), items_per_block=per_block)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 2, 4, 6, 8}
        assert "Join" not in kept._jdf.queryExecution().toString()


def test_leaks_empty_sides(spark, no_documents, odd_documents):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.find_leaks(odd_documents, none).collect() == []
    assert decontaminate.find_leaks(no_documents, spark.createDataFrame([(1, prose(1, 20))], ITEMS)).collect() == []
    assert decontaminate.drop_leaks(odd_documents, none).count() == odd_documents.count()


def test_leaks_in_blocks_of_items(spark):
    items = [(i, prose(100 + i, 20)) for i in range(9)]
    docs = spark.createDataFrame([(i, prose(i, 30) + " " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, items_per_block=2).collect()}
    assert got == {(i, i) for i in range(9)}


def test_align_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(30))]
        b = [rng.randrange(12) for _ in range(rng.randrange(30))]
        got = linededup.align(b, a)
        assert all(b[i] == a[j] for i, j in got)
        assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
        if a == b or not set(a) & set(b):
            assert len(got) == (len(a) if a == b else 0)
    x = [1, 2, 3, 4, 5]
    assert linededup.align(x, x) == [(i, i) for i in range(5)]
    assert linededup.align([9, *x, 8], [7, 7, *x]) == [(i + 1, i + 2) for i in range(5)]


@pytest.mark.parametrize("wrapped", [False, True])
def test_repeated_passage_goes_from_later_documents(spark, wrapped):
    passage = prose(77, 70)
    if wrapped:
        passage = passage.replace(".", "")
    docs = []
    for i in range(30):
        a, b = prose(1000 + i, 60), prose(2000 + i, 60)
        if wrapped:
            a, b = a.replace(".", ""), b.replace(".", "")
        docs.append((i, f"{a} {passage} {b}" if i % 3 == 0 else f"{a} {b}"))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOC_SCHEMA)
    out = {r["doc_id"]: r for r in linededup.line_dedup(df).collect()}
    assert set(out) == set(range(30))
    inner = passage[100:300]
    for i, t in docs:
        if i % 3 or i == 0:
            assert out[i]["text"] == t
        else:
            assert inner not in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"])
            assert prose(1000 + i, 60).replace(".", "")[:200] in out[i]["text"].replace(".", "")


def plain(seed, n):
    return prose(seed, n).replace(".", "").split()


def test_passages_over_50_words_go_wherever_they_stand(spark):
    """Any words around the same words: all of them go from the later text."""
    rng = random.Random(5)
    docs, want = [], {}
    for i in range(120):
        passage = plain(10_000 + i, rng.randint(51, 120))
        for k in range(2):
            around = prose(20_000 + 2 * i + k, 150).split() if i % 2 else plain(20_000 + 2 * i + k, 150)
            at = rng.randrange(len(around) + 1)
            docs.append((2 * i + k, " ".join(around[:at] + passage + around[at:])))
            want[2 * i + k] = " ".join(around).split() if k else docs[-1][1].split()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["text"].split() for r in linededup.line_dedup(df).collect()} == want


def test_passage_goes_though_each_line_is_older(spark):
    """Lines that first stand singly in other texts do not hide a passage."""
    lines = [" ".join(plain(30_000 + i, 8)) + "." for i in range(10)]
    docs = [(i, f"{prose(31_000 + i, 45)} {line} {prose(32_000 + i, 45)}") for i, line in enumerate(lines)]
    docs += [(20 + k, " ".join([prose(33_000 + k, 45), *lines, prose(34_000 + k, 45)])) for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in linededup.line_dedup(df).collect()}
    assert all(out[i] == t for i, t in docs[:11])
    assert all(out[20 + k] == f"{prose(33_000 + k, 45)} {prose(34_000 + k, 45)}" for k in (1, 2))


def test_swapped_and_repeated_passages_go(spark):
    """Earlier P Q, later Q P; earlier P once, later twice."""
    p, q = prose(40_000, 70), prose(40_001, 60)
    a, b, c = (prose(40_010 + i, 45) for i in range(3))
    docs = [(1, f"{a} {p} {b} {q} {c}")]
    for i, x, y in [(2, q, p), (3, p, p), (4, q, q)]:
        docs.append((i, " ".join([prose(41_000 + i, 45), x, prose(42_000 + i, 45), y, prose(43_000 + i, 45)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in linededup.line_dedup(df).collect()}
    assert out[1] == docs[0][1]
    for i in (2, 3, 4):
        assert out[i] == " ".join(prose(k + i, 45) for k in (41_000, 42_000, 43_000))


def test_blocks_hold_every_common_run():
    rng = random.Random(6)
    vocabulary = plain(44_000, 400)
    parts = [rng.choices(vocabulary, k=rng.randint(20, 80)) for _ in range(12)]
    for _ in range(100):
        one, two = ([w for p in rng.choices(parts, k=6) for w in p] for _ in range(2))
        (later, lines), (earlier, others) = linededup.cut(" ".join(one)), linededup.cut(" ".join(two))
        gone = set()
        for _, _, first, end in linededup.blocks(later, lines, linededup.Holder(earlier, others, 25), 25):
            assert " " + " ".join(one[first:end]) + " " in " " + " ".join(two) + " "
            gone |= set(range(first, end))
        for at in range(len(one) - 48 + 1):
            if " " + " ".join(one[at:at + 48]) + " " in " " + " ".join(two) + " ":
                assert len(gone & set(range(at, at + 48))) >= 26
                assert set(range(at + 11, at + 37)) <= gone


def test_line_dedup_odd_rows(odd_documents, no_documents, odd_rows):
    out = linededup.line_dedup(odd_documents)
    assert out.columns == odd_documents.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    same = odd_rows[0][1]
    assert got[1, same] == 1 and got[5, same] == 0 and got[8, same + " tail words here"] == 0
    assert got[2, None] == 1 and got[3, ""] == 1 and got[7, " \n "] == 1 and got[4, odd_rows[4][1]] == 1
    assert linededup.line_dedup(no_documents).collect() == []
    assert linededup.find_blocks(no_documents).collect() == []


def near_brute(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def chain(seed, n, size):
    """Texts that each differ a little from the one before."""
    rng = random.Random(seed)
    words = prose(seed, size).split()
    out = []
    for _ in range(n):
        out.append(" ".join(words))
        words = edit(words, rng, 3)
    return out


@pytest.mark.parametrize("small_bucket", [2, 12])
def test_near_duplicates_equal_brute_force(spark, odd_rows, small_bucket):
    rows = [r[:2] for r in odd_rows]
    n = 100
    for seed in range(6):
        for t in chain(seed, 25, 90):
            rows.append((n, t))
            n += 7
    rows += [(n + i, rows[30][1]) for i in range(40)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = neardup.near_duplicates(df, k=4, percent=80, small_bucket=small_bucket).collect()
    mine = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert mine == near_brute(rows, 4, 80)


@pytest.mark.parametrize("block_bytes", [neardup.BLOCK_BYTES, 2000])
def test_large_bucket_members_meet(spark, monkeypatch, block_bytes):
    """Two families in one bucket of the first band only meet through blocks:
    with one-row bands nearly everything shares a bucket.  Blocks that hold
    few bytes of sets find the same."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block_bytes)
    rows = []
    for seed in range(3):
        for i, t in enumerate(chain(50 + seed, 12, 60)):
            rows.append((seed * 100 + i, "the same opening words " + t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, k=4, percent=80, bands=20, rows=1, small_bucket=2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == near_brute(rows, 4, 80)


def test_near_duplicates_empty_and_drop(no_documents, odd_documents):
    assert neardup.near_duplicates(no_documents).collect() == []
    out = neardup.drop_near_duplicates(odd_documents, k=5)
    assert out.columns == odd_documents.columns
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert ids == Counter({1: 1, 2: 1, 3: 1, None: 2, 4: 1, 6: 1, 7: 1, 9: 1, 10: 1})


def test_miss_probability_of_the_signature_test():
    """Pairs at the similarity itself are pruned about as rarely as asked."""
    rng = np.random.default_rng(0)
    limits = neardup.least_matches(150, 30, 80, 1e-6)
    a = rng.integers(0, 256, (20_000, 150), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    live, _ = neardup.survives(a, b, limits)
    assert len(live) >= 0.999 * len(a)
    b = np.where(rng.random(a.shape) < 0.3, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    assert len(neardup.survives(a, b, limits)[0]) <= 0.001 * len(a)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1300)]
    edges += [(5000, 5001 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in
           components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_toxicity_sample_is_bounded_in_rows(spark, monkeypatch):
    """One id repeated very often is one row of the sample."""
    seen = []
    real = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda x, y: seen.append(len(y)) or real(x, y))
    rows = [(i, prose(i, 20) + (" idiot" if i % 2 else "")) for i in range(60)] + [(7, "you idiot " + str(k)) for k in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample_rows=60)
    assert seen and max(seen) <= 60


def test_toxicity_held_out(spark):
    from conftest import SF01

    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id").filter(toxicity.held_out(labels["doc_id"]))
    rows = [(r["score"], r["toxic"], r["predicted"]) for r in scored.collect()]
    yes, no = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))
    assert auc >= 0.85
    assert sum(p for _, y, p in rows if not y) <= 0.02 * len(no)


def test_toxicity_odd_rows(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd_documents, none)
    out = toxicity.drop_toxic(odd_documents, model)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    odd_labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 0), (5, 0), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_documents, odd_labels)
    rows = toxicity.score_documents(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_documents(no_documents, model).collect() == []


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    votes = np.column_stack([np.where(y, rng.random(3000) < 0.7, rng.random(3000) < 0.02) for _ in range(6)])
    given = np.where(rng.random(3000) < 0.1, ~y, y)  # a tenth of the labels are wrong
    q, _ = toxicity.label_model(votes.astype(np.float32), given.astype(float))
    assert ((q > 0.5) == y).mean() > (given == y).mean()


def test_pipeline_stages(spark, odd_rows):
    import corpus_pipeline as cp

    rng = random.Random(3)
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(3).collect()]
    rows = [(i, t) for i, t, *_ in odd_rows] + [(100 + i, prose(900 + i, 80) + " " + t) for i, t in enumerate(items)]
    base = prose(321, 150)
    rows += [(200, base), (201, " ".join(edit(base.split(), rng, 2)))]
    docs = with_clashes(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_SCHEMA))
    d = "/root/testdata/sf0.001"
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES][2] == "near_duplicates" and len(cp.STAGES) == 5
    near = stages["near_duplicates"](spark, docs, d)
    ids = {r["doc_id"] for r in near.select("doc_id").collect()}
    assert 200 in ids and 201 not in ids and 8 not in ids
    clean = stages["decontamination"](spark, docs, d)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows if i not in (100, 101, 102)}
    assert stages["toxicity"](spark, docs, d).columns == docs.columns
    assert stages["line_dedup"](spark, docs, d).columns == docs.columns
    assert stages["packing"](spark, docs, d).count() >= len(rows)


def test_components_after_more_links(spark):
    from proselens.llm.components import extended

    scratch = Scratch(spark, "t")
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = components(frame([(1, 2), (2, 3), (10, 11), (20, 21)]), scratch, "one-")
    got = {r["node"]: r["component"] for r in
           extended(known, frame([(3, 11), (30, 20), (40, 41), (1, 3)]), scratch, "two-").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 40: 40, 41: 40}
    same = extended(known, frame([(1, 3)]), scratch, "three-")
    assert {r["node"]: r["component"] for r in same.collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20}


def test_pipeline_stages_on_an_empty_table(spark, no_documents):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        out = stage(spark, no_documents, "/root/testdata/sf0.001")
        assert out.collect() == []
        if name != "packing":
            assert out.columns == no_documents.columns
