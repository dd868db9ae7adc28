"""License scan by ordered signature rules (operator 4, native).

A text is reduced to its words, single-spaced and fenced by spaces; a mark
replaces the space where a sentence ends, and no rule reaches across it.  A
keyword prefilter picks the sentences and rules worth trying: a rule runs only
on sentences that hold its keyword.  Every match is an interval of words with
the rule's priority.  In each sentence the longest intervals go first, by
priority, then those that they contain, the longer the earlier; an interval is
kept if it meets none that is kept already.  SPDX identifiers and expressions
are read from the text itself, so any id gives its label.  Everything is one
projection over the documents, array functions only: no shuffle, no Python;
what a text needs grows with its length and, within a sentence, with the
square of the sentence's matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import pick

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# (phrase, label): all places count; fixed by the contract of the scan
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


@dataclass(frozen=True)
class Family:
    """A license family: its label, the keyword that gates its rules, the
    pattern of its name over single-spaced lower-case words, patterns of text
    that only this license has, and their keyword if it is another.  A keyword
    is a word that every match holds, perhaps with a version joined to it."""

    label: str
    keyword: str
    name: str
    texts: tuple[str, ...] = ()
    text_keyword: str = ""


V = r"(?: v(?:ersion)? ?[0-9]+(?: [0-9]+)*| version [0-9]+(?: [0-9]+)*| [0-9]+(?: [0-9]+)*)?"

FAMILIES = (
    Family("mit", "mit", r"(?:the )?(?:expat )?mit(?: x11)?", ()),
    Family("mit", "charge", r"permission is hereby granted free of charge",
           (r"permission is hereby granted free of charge to any person obtaining a copy of this software",)),
    Family("apache", "apache", r"(?:the )?apache(?: software)?(?: license)?" + V, ()),
    Family("gpl", "gpl", r"(?:the )?(?:gnu )?gpl(?: ?v?[0-9]+(?: [0-9]+)*)?(?: only| or later)?", ()),
    Family("gpl", "public", r"(?:the )?(?:gnu )?general public license" + V,
           (r"under the terms of the gnu general public license as published by the free software foundation",)),
    Family("lgpl", "lgpl", r"(?:the )?(?:gnu )?lgpl(?: ?v?[0-9]+(?: [0-9]+)*)?(?: only| or later)?", ()),
    Family("lgpl", "lesser", r"(?:the )?(?:gnu )?lesser general public license" + V, ()),
    Family("lgpl", "library", r"(?:the )?gnu library general public license" + V, ()),
    Family("agpl", "agpl", r"(?:the )?(?:gnu )?agpl(?: ?v?[0-9]+(?: [0-9]+)*)?", ()),
    Family("agpl", "affero", r"(?:the )?(?:gnu )?affero general public license" + V, ()),
    Family("gfdl", "documentation", r"(?:the )?(?:gnu )?free documentation license" + V, ()),
    Family("bsd", "bsd", r"(?:the )?(?:new |modified |simplified |revised )?(?:bsd [0-9] clause|[0-9] clause bsd|bsd)(?: style)?", ()),
    Family("bsd", "redistribution", r"redistribution and use in source and binary forms",
           (r"redistribution and use in source and binary forms with or without modification are permitted",)),
    Family("mpl", "mpl", r"(?:the )?mpl(?: ?v?[0-9]+(?: [0-9]+)*)?", ()),
    Family("mpl", "mozilla", r"(?:the )?mozilla public license" + V, ()),
    Family("epl", "epl", r"(?:the )?epl(?: ?v?[0-9]+(?: [0-9]+)*)?", ()),
    Family("epl", "eclipse", r"(?:the )?eclipse public license" + V, ()),
    Family("cddl", "cddl", r"(?:the )?cddl(?: ?v?[0-9]+(?: [0-9]+)*)?", ()),
    Family("cddl", "distribution", r"(?:the )?common development and distribution license" + V, ()),
    Family("isc", "isc", r"(?:the )?isc", ()),
    Family("isc", "modify", r"permission to use copy modify and or distribute this software for any purpose", ()),
    Family("zlib", "zlib", r"(?:the )?zlib(?: libpng)?", ()),
    Family("boost", "boost", r"(?:the )?boost software license" + V, ()),
    Family("boost", "bsl", r"bsl 1 0", ()),
    Family("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    Family("wtfpl", "wtfpl", r"(?:the )?wtfpl" + V, ()),
    Family("artistic", "artistic", r"(?:the )?artistic license" + V, ()),
    Family("python", "psf", r"(?:the )?psf", ()),
    Family("python", "python", r"(?:the )?python software foundation license" + V, ()),
    Family("ofl", "ofl", r"(?:the )?(?:sil )?ofl(?: [0-9]+(?: [0-9]+)*)?", ()),
    Family("ofl", "font", r"(?:the )?sil open font license" + V, ()),
    Family("eupl", "eupl", r"(?:the )?eupl(?: ?v?[0-9]+(?: [0-9]+)*)?", ()),
    Family("ms-pl", "microsoft", r"(?:the )?microsoft (?:public|reciprocal) license", ()),
    Family("ms-pl", "ms", r"ms (?:pl|rl)", ()),
    Family("odbl", "database", r"(?:the )?open database license" + V, ()),
    Family("cc0", "cc0", r"cc0(?: [0-9]+(?: [0-9]+)*)?(?: universal)?",
           (r"to the extent possible under law",), "extent"),
    Family("cc-by", "cc", r"cc by(?: [0-9] [0-9])?", ()),
    Family("cc-by-sa", "cc", r"cc by sa(?: [0-9] [0-9])?", ()),
    Family("cc-by-nd", "cc", r"cc by nd(?: [0-9] [0-9])?", ()),
    Family("cc-by-nc", "cc", r"cc by nc(?: [0-9] [0-9])?", ()),
    Family("cc-by-nc-sa", "cc", r"cc by nc sa(?: [0-9] [0-9])?", ()),
    Family("cc-by-nc-nd", "cc", r"cc by nc nd(?: [0-9] [0-9])?", ()),
    Family("cc", "creative", r"(?:a |the )?creative commons(?: attribution)?(?: noncommercial| non commercial)?"
                             r"(?: sharealike| share alike| noderivs| no derivatives)?" + V, ()),
    Family("public-domain", "domain", r"(?:the )?public domain", (r"released into the public domain",)),
    Family("proprietary", "proprietary", r"proprietary and confidential", ()),
    Family("proprietary", "reserved", r"all rights reserved", ()),
    Family("proprietary", "confidential", r"strictly confidential", ()),
)

# Ways in which a text names a license: (priority, confidence, pattern with a
# place for the name).  Lower priorities win.
TEMPLATES = (
    (2, 0.99, r"spdx license identifier {name}(?: license)?"),
    (3, 0.97, r"(?:is |are |be )?(?:re ?)?licen[sc]ed under (?:the terms of )?(?:the )?{name}(?: licen[sc]e)?" + V),
    (3, 0.95, r"(?:is |are )?(?:released|distributed|available|published|covered) under (?:the terms of )?{name}(?: licen[sc]e)?" + V),
    (4, 0.95, r"(?:subject to|under) the terms (?:and conditions )?of (?:the )?{name}(?: licen[sc]e)?" + V),
    (5, 0.9, r"licen[sc]e {name}"),
    (6, 0.9, r"{name} licen[sc]e" + V),
)
# Names that say enough without the word license around them.
BARE = {"agpl", "lgpl", "gpl", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "cc", "cc0",
        "public-domain", "proprietary", "unlicense", "wtfpl", "gfdl", "cddl", "eupl", "ofl", "mpl", "epl", "odbl",
        "artistic", "boost", "ms-pl", "python"}


def rules() -> list[tuple[str, str, int, float, str]]:
    """All rules in order: (keyword, label, priority, confidence, pattern)."""
    out = []
    for f in FAMILIES:
        out += [(f.text_keyword or f.keyword, f.label, 1, 1.0, t) for t in f.texts]
        out += [(f.keyword, f.label, p, c, t.replace("{name}", f"(?:{f.name})")) for p, c, t in TEMPLATES]
        if f.label in BARE or f.name.startswith(("permission", "redistribution")):
            out.append((f.keyword, f.label, 7, 0.7, f.name))
    return sorted(out, key=lambda r: (r[2], -r[3], r[1], r[4]))


def gate_pattern(signatures: list[tuple[str, str, int, float, str]]) -> str:
    """Finds the keywords in single-spaced words, at their own end or before a
    joined version (gplv3); the longest first, so that cc0 is not cc."""
    keywords = sorted({r[0] for r in signatures}, key=lambda k: (-len(k), k))
    return "(?i)(?<= )(?:" + "|".join(keywords) + ")(?=(?:v?[0-9]+)? )"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_text(text: Column) -> Column:
    """Words, single-spaced, with a space at either end."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), NOT_WORD, " ")


# Stands for the separator where a sentence ends.
MARK = "\x01"
_OTHER = NOT_WORD.replace(r"\x00-", r"\x00\x02-")[:-1]  # a character that is neither word nor mark


def marked_text(text: Column) -> Column:
    """As ``words_text``, word for word, with MARK for the space at the end of
    a sentence: a full stop, semicolon, exclamation or question mark before
    white space or the end."""
    c = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), MARK, " "), F.lit(" "))
    c = F.regexp_replace(c, rf"[.;!?][\x00-\x20]{_OTHER}*+", MARK)
    c = F.regexp_replace(c, rf"(?<!{_OTHER}){_OTHER}++{MARK}", MARK)
    return F.regexp_replace(c, rf"{_OTHER}++", " ")


def _spaces(c: Column) -> Column:
    """Separators of a text."""
    return F.length(c) - F.length(F.translate(c, " " + MARK, ""))


# SPDX stems whose label is another.
SPDX_ALIASES = {"bsl": "boost", "psf": "python", "0bsd": "bsd", "ms-rl": "ms-pl", "x11": "mit"}
_SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX = rf"(?i:SPDX-License-Identifier):[ \t(]*({_SPDX_ID}(?:[ \t)]+(?:OR|AND|WITH)[ \t(]+{_SPDX_ID})*)"
# Without the tag: at least two ids that can be nothing else.
_SURE_ID = r"(?:MIT|ISC|Zlib|0BSD|Unlicense|WTFPL|[A-Za-z]+(?:-[A-Za-z]+)*-[0-9][0-9.]*(?:-Clause|-only|-or-later|[+])?)"
EXPRESSION = rf"\b({_SURE_ID}(?:[ \t)]+(?:OR|AND)[ \t(]+{_SURE_ID})+)(?![A-Za-z0-9-])"


def spdx_labels(text: Column) -> Column:
    """Sorted labels of the SPDX identifiers and expressions of a text: the id in lower case
    without version, or the family's label; exceptions have none."""
    found = F.flatten(F.transform(
        F.concat(*[F.regexp_extract_all(text, F.lit(rx), F.lit(1)) for rx in (SPDX, EXPRESSION)]),
        lambda e: F.split(F.regexp_replace(e, rf"[ \t)(]+WITH[ \t(]+{_SPDX_ID}", ""), r"[ \t)(]+(?:OR|AND)[ \t)(]+")))
    stems = F.transform(found, lambda i: F.regexp_replace(F.lower(i), r"-v?[0-9].*$|[+]$|-?[0-9.]+[+]?$", ""))
    names = F.create_map(*[F.lit(x) for pair in SPDX_ALIASES.items() for x in pair])
    labels = F.transform(F.zip_with(found, stems, lambda i, x: F.when(x == "", F.lower(i)).otherwise(x)),
                         lambda x: F.coalesce(F.try_element_at(names, x), x))
    return F.array_sort(F.array_distinct(labels))


def _places(words: Column, pattern: Column) -> Column:
    """Intervals (a, b) of words, b exclusive, of all matches of a pattern.
    Matches begin after a space and end before one."""
    gaps = F.split(words, pattern)
    hits = F.regexp_extract_all(words, pattern, F.lit(0))
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<a:int,b:int>>))")

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + _spaces(x["gap"])
        b = a + _spaces(x["hit"]) + 1
        return F.struct((b - 1).alias("at"),
                        F.concat(acc["out"], F.array(F.struct((a - 1).alias("a"), (b - 1).alias("b")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits,
                       lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def scan_licenses(documents: DataFrame, signature_rules: list[tuple[str, str, int, float, str]] | None = None) -> DataFrame:
    """Licenses of every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, ``spans``: the kept detections (a, b, priority, label,
    confidence), words from a to before b, and ``spdx``: labels of SPDX ids.  A null or empty text has no words,
    empty labels and score 0; repeated rows are scanned each; an empty table
    gives no rows; other columns are ignored.
    """
    signatures = rules() if signature_rules is None else signature_rules
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(lab).alias("label"), F.lit(p).alias("priority"),
                               F.lit(float(c)).alias("confidence"), F.lit(f"(?i)(?<= )(?:{rx})(?= )").alias("pattern"))
                      for k, lab, p, c, rx in signatures])
    gate = gate_pattern(signatures)
    base_gate = "(?i)(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"
    docs = pick(documents, "doc_id", "text").select("doc_id", "text", words_text(F.col("text")).alias("_w"))
    none = F.expr("cast(array() as array<struct<a:int,b:int,priority:int,label:string,confidence:double>>)")

    def phrase(p: str, label: str) -> Column:
        return F.transform(_places(F.col("_w"), F.lit(f"(?i)(?<= )(?:{p})(?= )")),
                           lambda x: F.struct(x["a"].alias("a"), F.lit(label).alias("label")))

    base = F.when(F.col("_w").rlike(base_gate), F.array_sort(F.concat(*[phrase(p, lab) for p, lab in BASE]))).otherwise(
        F.expr("cast(array() as array<struct<a:int,label:string>>)"))
    span = "struct<a:int,b:int,priority:int,label:string,confidence:double>"

    def spans(words: Column, keywords: Column) -> Column:
        """All matches in a sentence: of equal intervals the best one, the
        contained ones marked."""
        tried = F.filter(table, lambda r: F.array_contains(keywords, r["keyword"]))
        found = F.flatten(F.transform(tried, lambda r: F.transform(
            _places(words, r["pattern"]),
            lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), r["priority"].alias("priority"),
                               (-r["confidence"]).alias("doubt"), r["label"].alias("label")))))
        best = let(F.array_sort(F.array_distinct(found)), lambda xs: F.filter(
            xs, lambda x, i: (i == 0) | ~F.coalesce((F.get(xs, i - 1)["a"] == x["a"]) & (F.get(xs, i - 1)["b"] == x["b"]),
                                                    F.lit(False))))
        return let(best, lambda xs: F.transform(xs, lambda x: F.struct(
            F.exists(xs, lambda y: (y["a"] <= x["a"]) & (x["b"] <= y["b"])
                     & ((y["a"] != x["a"]) | (y["b"] != x["b"]))).alias("inner"), x.alias("x"))))

    def resolved(marked: Column) -> Column:
        """An interval is kept if it meets none that is kept already."""
        def order(inner: bool) -> Column:
            some = F.filter(marked, lambda m: m["inner"] == F.lit(inner))
            return F.array_sort(F.transform(some, lambda m: F.struct(
                (m["x"]["a"] - m["x"]["b"] if inner else F.lit(0)).alias("size"), m["x"]["priority"].alias("priority"),
                m["x"]["a"].alias("a"), m["x"]["b"].alias("b"), m["x"]["label"].alias("label"),
                (-m["x"]["doubt"]).alias("confidence"))))

        def step(acc: Column, x: Column) -> Column:
            met = F.exists(acc, lambda k: (k["a"] < x["b"]) & (x["a"] < k["b"]))
            mine = F.struct(*[x[c].alias(c) for c in ("a", "b", "priority", "label", "confidence")])
            return F.when(met, acc).otherwise(F.concat(acc, F.array(mine)))

        start = F.expr(f"cast(array() as array<{span}>)")
        return F.array_sort(F.aggregate(F.concat(order(False), order(True)), start, step))

    def keys(words: Column) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(words, F.lit(gate), F.lit(0)), F.lower))

    def by_sentence(marked: Column) -> Column:
        # fenced sentences with the number of words before each
        parts = F.transform(F.split(marked, MARK), lambda s, i: F.struct(
            F.concat(F.when(i == 0, "").otherwise(" "), s, F.lit(" ")).alias("s"), i.alias("i")))
        hit = F.filter(parts, lambda p: p["s"].rlike(gate))

        def found(p: Column) -> Column:
            before = F.when(p["i"] == 0, 0).otherwise(_spaces(F.call_function("substring_index", marked, F.lit(MARK), p["i"])))
            kept = let(keys(p["s"]), lambda k: let(spans(p["s"], k), resolved))
            return let(before, lambda n: F.transform(kept, lambda x: F.struct(
                (x["a"] + n).alias("a"), (x["b"] + n).alias("b"), x["priority"].alias("priority"),
                x["label"].alias("label"), x["confidence"].alias("confidence"))))
        return F.flatten(F.transform(hit, found))

    scanned = docs.select(
        "doc_id", _spaces(F.col("_w")).cast("long").alias("_spaces"), base.alias("_base"),
        F.when(F.col("_w").rlike(gate), let(marked_text(F.col("text")), by_sentence)).otherwise(none).alias("spans"),
        F.when(F.col("_w").rlike(" (?:(?i:spdx license identifier)|OR|AND) "), spdx_labels(F.col("text")))
        .otherwise(F.expr("cast(array() as array<string>)")).alias("spdx"))
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda x: x["label"])))
    label_list = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("spans", lambda x: x["label"]),
                                                        "spdx")))
    n_base = F.size("_base").cast("long")
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["confidence"])), F.lit(0.0))
    return scanned.select(
        "doc_id", F.greatest(F.col("_spaces") - 1, F.lit(0)).alias("n_words"), n_base.alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["a"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["a"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(label_list, ",").alias("labels"),
        F.greatest(best, F.when(n_base > 0, 0.9).otherwise(0.0),
                   F.when(F.size("spdx") > 0, 0.99).otherwise(0.0)).alias("score"), "spans", "spdx")
