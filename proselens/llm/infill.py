"""Fill-in-the-middle transformation by counted quantifiers (operator 13).

A text is a row of units (a run of ASCII letters, or any other code point).
``regexp_count`` gives their number n; two cuts a <= b of 0..n become a
pattern of the row's own, ``(unit{a}+)(unit{b-a}+)(rest)``, and one match of it
captures prefix, middle and suffix.  The quantifiers are possessive: the units
before a cut are fixed, so the matcher keeps no way back and needs neither
stack nor time beyond one walk over the text.

Everything is one projection of Spark's own expressions, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import pick

# The units and the marks of prefix, suffix and middle.
UNIT = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Code points whose units are counted at a time: ``regexp_count`` holds one
# array entry per unit, so this bounds what a very long text needs.
COUNT_CHARS = 1 << 20


def count_units(text: Column, chars: int = COUNT_CHARS) -> Column:
    """Units of a text.  A longer text than ``chars`` is counted in stretches;
    a run of letters that a border cuts is one unit less."""
    def stretch(i: Column) -> Column:
        here = F.substring(text, i * chars + 1, F.lit(chars))
        border = F.substring(text, i * chars, F.lit(2))
        cut = (i > 0) & border.rlike("^[A-Za-z]{2}$")
        return F.regexp_count(here, F.lit(UNIT)).cast("long") - cut.cast("long")

    last = F.floor((F.char_length(text) - 1) / chars)
    long = F.aggregate(F.sequence(F.lit(0), last.cast("int")), F.lit(0).cast("long"), lambda n, i: n + stretch(i))
    return F.when(F.char_length(text) > chars, long).otherwise(F.regexp_count(text, F.lit(UNIT)).cast("long"))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text behind an output: the inverse of ``infill``."""
    in_order = {"psm": (PREFIX, SUFFIX, MIDDLE, "$1$3$2"), "spm": (SUFFIX, PREFIX, MIDDLE, "$2$3$1")}
    back = F.when(form == "plain", output)
    for name, (x, y, z, order) in in_order.items():
        back = back.when(form == name, F.regexp_replace(output, rf"(?s)\A{x}(.*?){y}(.*?){z}(.*+)\z", order))
    return back


def infill(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Every document as (doc_id, text, n, a, b, form, output).

    A null text is empty, an empty text or one that holds a mark stays plain,
    a null doc_id draws like the empty string, repeated rows give equal rows,
    an empty table none; other columns are ignored.
    """
    h1, h2, h3, h4 = (F.col(f"h{i}") for i in range(1, 5))
    n, a, b, text = (F.col(c) for c in ("n", "a", "b", "text"))
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", count_units(text).alias("n"),
                       *[h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h3 % 100 >= 100 - plain_percent)
    rows = rows.select(
        "doc_id", "text", "n", F.least(h1 % (n + 1), h2 % (n + 1)).alias("a"),
        F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("b"),
        F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    pattern = F.concat(F.lit(rf"(?s)\A((?:{UNIT}){{"), a.cast("string"), F.lit(rf"}}+)((?:{UNIT}){{"),
                       (b - a).cast("string"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(
        f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", text).otherwise(F.regexp_replace(text, pattern, order))
    return rows.select("*", output.alias("output"))


def part_lengths(infilled: DataFrame) -> DataFrame:
    """``infill``'s rows with prefix_chars and middle_chars in code points,
    null where plain.  No mark can begin inside another or across a border, so
    the first one found is the one that was written."""
    out, form = F.col("output"), F.col("form")
    # a mark is three characters long; locate counts characters from 1
    prefix = F.when(form == "psm", F.instr(out, SUFFIX) - 4).when(
        form == "spm", F.instr(out, MIDDLE) - F.instr(out, PREFIX) - 3)
    middle = F.when(form != "plain", F.char_length(out) - F.instr(out, MIDDLE) - 2)
    return infilled.select("*", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"))
