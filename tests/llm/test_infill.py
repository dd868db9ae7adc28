"""Operator 13 against a direct version, unit by unit."""

import hashlib
import random
import re

import pytest
from llm.conftest import DOC_SCHEMA
from pyspark.sql import functions as F

from proselens.llm import infill


def direct(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, text, n, "plain", text, None, None
    if h[3] % 100 < 20:
        return doc_id, text, n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return doc_id, text, n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def texts():
    rng = random.Random(13)
    odd = ["", None, "a", "ab c", "x<P>y", "<S>", "<M", "a<b", "<<P", "é\U0001F600b\nab\r\n", "\n", "\r\n", "a$1\\2 b", "  ",
           "Ab1" * 40, "é", "\x00", " x"]
    return odd + ["".join(rng.choice("abZ<>PSM é\U0001F600\n$\\") for _ in range(rng.randrange(60))) for _ in range(300)]


def results(df):
    return infill.part_lengths(infill.infill(df)).withColumn("back", infill.restore(F.col("output"), F.col("form")))


def test_equals_the_direct_version(spark):
    rows = list(enumerate(texts())) + [(None, "hello there"), (5, "again"), (5, "again"), (None, None)]
    got = results(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(got, rows):
        assert (r.doc_id, r.text, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == direct(doc_id, text)
        assert r.back == (text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("chars", [2, 3, 7, 64])
def test_counting_in_stretches_changes_nothing(spark, chars):
    df = spark.createDataFrame(list(enumerate(t for t in texts() if t)), "doc_id long, text string")
    bad = df.filter(infill.count_units(F.col("text"), chars) != F.regexp_count("text", F.lit(infill.UNIT)))
    assert bad.count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "ab, é\n" * 500_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    rows = results(df).withColumn("same", F.col("back") == F.col("text")).collect()
    assert [(r.n, r.same) for r in rows] == [(2_500_000, True), (1, True)]


def test_odd_tables(odd_documents, odd_rows, no_documents, spark):
    got = sorted((tuple(r)[:-1] for r in results(odd_documents).select(
        "doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars", "back").collect()), key=repr)
    assert got == sorted((direct(r[0], r[1]) for r in odd_rows), key=repr)
    assert results(no_documents).count() == 0
    assert results(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_one_projection(odd_documents):
    plan = results(odd_documents)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Exchange", "Python", "Pandas", "Arrow", "InMap"))
