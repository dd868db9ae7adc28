"""Operators 3, 4, 9 and 10 against brute force."""

import base64
import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import with_clashes
from proselens.llm import licenses, urlfilter, vptree, warc
from proselens.llm.common import Scratch

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, tuple(float(np.float32(x)) for x in v))
    width = max({len(v) for v in good.values()}, key=lambda n: (sum(len(v) == n for v in good.values()), -n), default=0)
    good = {i: v for i, v in good.items() if len(v) == width}
    out = []
    for q, a in good.items():
        if is_query(q):
            s = []
            for i, b in good.items():
                if i != q:
                    t = 0.0
                    for x, y in zip(a, b):
                        t += x * y
                    s.append((-t, i))
            out += [(q, r + 1, i, -t) for r, (t, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,query_block", [(8192, 8192), (40, 7)])
def test_search_is_exact_at_factor_one(spark, shard_rows, query_block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.integers(1, 4)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # a group of equal vectors
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [float("nan")] * 6),
             (405, [float("inf")] * 6), (None, [1.0] * 6), (406, [1.0, 2.0]), rows[20], rows[20]]
    df = with_clashes(spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS))
    got = vptree.nearest(df, F.col("vec_id") % 5 == 0, 6, 1.0, shard_rows, query_block, 64).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, lambda q: q % 5 == 0, 6)


def test_relaxed_search_keeps_recall(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(2000)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    got = {(r["query_id"], r["vec_id"]) for r in
           vptree.nearest(df, F.col("vec_id") % 50 == 0, 10, 1.2, 1000, 100, 200).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, lambda q: q % 50 == 0, 10)}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("scale", [1e200, 1e120, 1e-120, 1e-200])
def test_search_beyond_the_range_of_squares(spark, scale):
    """Infinite products and products that vanish are ordered as doubles are."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) * (scale if i % 3 else 1.0) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, F.col("vec_id") % 5 == 0, 6, 1.0, 25, 5, 64).collect()
    want = []
    for q, a in rows[::5]:
        s = []
        for i, b in rows:
            if i != q:
                t = 0.0
                for x, y in zip(a, b):
                    t += x * y
                s.append((0 if math.isnan(t) else 1, 0.0 if math.isnan(t) else -t, i, t))
        want += [(q, r + 1, i, str(t)) for r, (_, _, i, t) in enumerate(sorted(s)[:6])]
    assert [(r["query_id"], r["rank"], r["vec_id"], str(r["score"])) for r in
            sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == want


def test_search_empty(spark):
    assert vptree.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).collect() == []


def license_brute(text):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_columns(spark, odd_documents, odd_rows):
    texts = ["MIT License", "mit-license! MIT license mit license", "the GNU General Public License, version 3 or later",
             "xmit license", "MİT license K apache license", "apache  license apache license", None,
             "Licensed under the Apache License, Version 2.0.", "Released under CC BY-NC-SA 4.0", "é mit license é",
             ("mit license " * 3000)]
    extra = [(100 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = odd_documents.select("doc_id", "text").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n int").select("doc_id", "text"))
    got = licenses.scan_licenses(with_clashes(df)).collect()
    want = sorted([(i if i is not None else -1, *license_brute(t)) for i, t, *_ in [*odd_rows, *extra]], key=str)
    assert sorted([(r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_base"], r["first_word"],
                    r["last_word"], r["base_labels"]) for r in got], key=str) == want
    by = {r["doc_id"]: r for r in got}
    assert by[107]["labels"] == "apache" and by[108]["labels"] == "cc-by-nc-sa" and by[102]["labels"] == "gpl"
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)


def test_license_spans_do_not_contain_each_other(spark):
    df = spark.createDataFrame([(1, "This is licensed under the terms of the GNU Lesser General Public License version 2.1 "
                                    "and the MIT License. SPDX-License-Identifier: MIT")], "doc_id long, text string")
    spans = licenses.scan_licenses(df).first()["spans"]
    assert {s["label"] for s in spans} == {"lgpl", "mit"}
    for x, y in zip(spans, spans[1:]):
        assert x["a"] < y["a"] and x["b"] < y["b"]


def direct_spans(text):
    """All rules over the words of each sentence, resolved pair by pair."""
    kept, at = [], 0
    for sentence in re.split(r"[.;!?](?=[\x00-\x20]|$)", text):
        words = re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", sentence)
        line = " " + " ".join(words).lower() + " "
        found = set()
        for _, label, priority, confidence, rx in licenses.rules():
            for m in re.finditer(f"(?<= )(?:{rx})(?= )", line):
                a = line[:m.start()].count(" ") - 1
                found.add((a, a + m[0].count(" ") + 1, priority, label, confidence))
        found = {s for s in found if not any(t[:2] == s[:2] and (t[2], -t[4], t[3]) < (s[2], -s[4], s[3]) for t in found)}
        inner = {s for s in found if any(t[0] <= s[0] and s[1] <= t[1] and t[:2] != s[:2] for t in found)}
        queue = sorted(found - inner, key=lambda s: (s[2], s[0])) + sorted(inner, key=lambda s: (s[0] - s[1], s[2], s[0]))
        here = []
        for s in queue:
            if all(s[1] <= t[0] or t[1] <= s[0] for t in here):
                here.append(s)
        kept += [(a + at, b + at, label) for a, b, _, label, _ in here]
        at += len(words)
    return sorted(kept)


def test_license_rules_by_brute_force(spark):
    """Kept spans equal a direct evaluation of all rules, sentence by sentence."""
    texts = [
        "Released under the BSD 3-Clause license. All rights reserved. Redistribution and use in source and binary "
        "forms, with or without modification, are permitted. See the Mozilla Public License 2.0 license; public domain.",
        "See the Mozilla Public License 2.0 license; public domain.",
        "... Artistic License. The GNU General Public License; ISC license.", "EPL-2.0 license", "MIT OR Apache-2.0",
        "Under the MIT license MIT license under the terms of the GPL v3 license Apache license! licensed under GPLv2 or later.",
        "mit license " * 40, "; . mit license", ". ", "(MIT license). 'Apache License, Version 2.0'; and \n\nGPL"]
    rng = random.Random(8)
    bits = ["license", "licensed under", "the", "MIT", "gpl", "v3", "2.0", "Apache", "public domain", "general public license",
            ".", ";", "\n", "under the terms of", "BSD", "3-clause", "cc by", "sa", "mpl", "GNU", "released under", "word"]
    texts += [" ".join(rng.choices(bits, k=rng.randint(3, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        assert [(s["a"], s["b"], s["label"]) for s in got[i]["spans"]] == direct_spans(text), text
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["mpl,public-domain", "artistic,gpl,isc", "epl", "apache,mit"]


def test_spdx_identifiers_and_expressions(spark):
    cases = {"// SPDX-License-Identifier: EPL-2.0\nint x;": "epl", "SPDX-License-Identifier: MS-PL": "ms-pl",
             "# SPDX-License-Identifier: BSL-1.0": "boost", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-SA-4.0":
             "apache,cc-by-sa,mit", "spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0": "gpl",
             "SPDX-License-Identifier: LicenseRef-Own AND Sleepycat": "licenseref-own,sleepycat",
             "SPDX-License-Identifier: GPL-2.0+ and then prose": "gpl", "SPDX-License-Identifier:": "", "no id": "",
             "choose MIT OR Apache-2.0.": "apache,mit", "this AND that OR MIT-like OR 3-1": "", "MIT OR": ""}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_very_many_hits_in_one_text(spark):
    line = "Licensed under the MIT License. "
    row = licenses.scan_licenses(spark.createDataFrame([(1, line * 4000)], "doc_id long, text string")).first()
    assert row["n_words"] == 20_000 and row["n_base"] == 4000 and len(row["spans"]) == 4000 and row["labels"] == "mit"
    assert row["spans"][3999]["a"] == 3999 * 5


def sample(tree, rng):
    """A random string that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "IN":
            lo, hi = arg[0][1] if str(arg[0][0]) == "RANGE" else (arg[0][1],) * 2
            out += chr(rng.randint(lo, hi))
        elif kind == "MAX_REPEAT":
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif kind == "SUBPATTERN":
            out += sample(arg[3], rng)
        else:
            assert kind == "BRANCH"
            out += sample(rng.choice(arg[1]), rng)
    return out


def test_license_gate_passes_all_that_the_rules_match():
    rng = random.Random(3)
    gate = re.compile(licenses.gate_pattern(licenses.rules()))
    for keyword, _, _, _, rx in licenses.rules():
        tree = re._parser.parse(rx)
        for _ in range(40):
            text = f" {sample(tree, rng)} "
            assert re.fullmatch(f" (?:{rx}) ", text) and keyword in gate.findall(text), (keyword, text)


def test_license_versions_joined_to_the_name(spark):
    want = {"Licensed under GPLv3": "gpl", "the LGPLv2.1 or later": "lgpl", "See AGPLv3.": "agpl", "under MPLv2": "mpl",
            "CDDLv1.0": "cddl", "EUPLv1.2": "eupl", "GPL3": "gpl", "License: CC0 1.0": "cc0", "CC BY 4.0": "cc-by",
            "to the extent possible under law": "cc0", "gplx gplv": "", "xgplv3": "",
            "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc"}
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert got == dict(enumerate(want.values()))


def test_license_empty(no_documents):
    assert licenses.scan_licenses(no_documents).collect() == []


PAGES = "page_id long, url string, html string"
PAGE_ROWS = [(5, "http://a.org/x", "same"), (3, "http://a.org/y", "same"), (9, None, None), (4, "http://b.com/\nz", ""),
             (None, "u", "same"), (7, "http://c.net", "é" * 40_000), (7, "http://c.net", "é" * 40_000), (3, "again", "same"),
             (2, "http://d/", "a\r\n\r\nb"), (None, None, None)]


def test_warc_round_trip(spark):
    df = with_clashes(spark.createDataFrame(PAGE_ROWS, PAGES))
    scratch = Scratch(spark, "t")
    index = warc.write_archives(df, scratch, segment_bytes=300)
    got = warc.read_records(index).collect()
    first = {}
    for p, _, h in PAGE_ROWS:
        first[h or ""] = min((x for x in (p, first.get(h or "")) if x is not None), default=None)
    want = []
    for p, u, h in PAGE_ROWS:
        f, raw = first[h or ""], (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        response = f is None or f == p
        want.append((p, len(raw), digest, "response" if response else "revisit", None if response else f,
                     raw if response else None))
    key = lambda x: str(x)
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"])) for r in got], key=key) == sorted(want, key=key)
    some = warc.read_records(index.filter("page_id = 7")).collect()
    assert [bytes(r["payload"]) for r in some] == [("é" * 40_000).encode()] * 2


def test_warc_reads_in_tasks_by_bytes(spark):
    rows = [(i, f"http://a/{i}", random.Random(i).randbytes(3000).hex()) for i in range(40)]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES), Scratch(spark, "t"))
    read = warc.read_records(index, task_bytes=20_000)
    parts = read.select("page_id", F.spark_partition_id().alias("part")).collect()
    assert sorted(r["page_id"] for r in parts) == list(range(40)) and len({r["part"] for r in parts}) >= 4


def test_warc_minimum_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "yyyyy"), (4, "d", "yyyyy")], PAGES)
    got = {r["page_id"]: r["record_type"] for r in warc.archive_and_read(df, least_revisit_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).collect() == []


def test_warc_corrupt_payload_is_found():
    raw = warc.record(1, "u", b"abc", warc.sha1(b"abd"), None, False, "2020-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(raw)


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 40, 10), ("b", 50, 10)]
    assert [(f, s, e) for f, s, e, _ in warc.ranges(rows, 0, 100)] == [("a", 0, 20), ("a", 40, 50), ("b", 50, 60)]
    assert [(f, s, e) for f, s, e, _ in warc.ranges(rows, 20, 100)] == [("a", 0, 50), ("b", 50, 60)]
    assert len(list(warc.ranges(rows, 20, 10))) == 4


def url_brute(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", None, None
    host = m[1].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES
            if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, m[2], best[1], best[2]


URLS = ["http://EXAMPLE.org/es/1", "https://x.example.org/en/12?q", "https://x.example.org/en/2", "http://a.com/fr/1#t",
        "http://a.com/de/1", "http://a.com/en/9", "http://a.com", "http://org/", "http://xorg/", None, "", "no scheme",
        "://h/p", "a://b://c/d", "http://Ö.com/fr/é", "http://a.com/de", "http://u@a.com:80/de/", "http://a.com?x=/fr/"]


def test_url_rules(spark):
    df = with_clashes(spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS + URLS)], PAGES))
    for r in urlfilter.judge_urls(df).collect():
        host, path, rule, verdict = url_brute((URLS + URLS)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_url_templates_learn_from_rules(spark):
    urls = [f"http://bad.com/de/{i}" for i in range(40)] + [f"http://bad.com/xx/{i}" for i in range(5)]
    urls += [f"http://good.com/fr/{i}" for i in range(40)] + [f"http://good.com/xx/{i}" for i in range(5)]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    got = {r["page_id"]: r for r in urlfilter.judge_urls(df).collect()}
    assert {got[i]["verdict"] for i in range(40, 45)} == {"block"}
    assert {got[i]["verdict"] for i in range(85, 90)} == {"allow"}
    assert got[0]["template"] == "/~/<n>" or got[0]["template"].endswith("<n>")


def tree_brute(urls, many=10, few_pages=3.0, strength=4.0, z=2.0):
    """(host, look) -> (template, share), node by node from (host, look, verdict) rows."""
    leaves = {}
    for host, look, verdict in urls:
        leaf = leaves.setdefault((host, look), [0, 0, 0])
        leaf[0] += 1
        leaf[1] += verdict == "allow"
        leaf[2] += verdict == "block"
    tally = lambda xs, i: sum(leaves[x][i] for x in xs)
    smooth = lambda g, b, prior: (g + strength * prior) / (g + b + strength)
    everything = (tally(leaves, 1) + 1) / (tally(leaves, 1) + tally(leaves, 2) + 2)
    template = {}

    def name(seg):
        return "\\" + seg if re.fullmatch(r"\\*[*~]", seg) else seg

    def descend(node, here, level):
        children = {}
        for x in here:
            parts = x[1].split("/")
            children.setdefault(parts[level] if level < len(parts) else "", []).append(x)
        pooled = smooth(tally(here, 1), tally(here, 2), everything)
        below = {}
        for seg, xs in children.items():
            g, b = tally(xs, 1), tally(xs, 2)
            spread = math.sqrt(pooled * (1 - pooled) / (g + b + strength))
            merged = name(seg)
            if len(children) >= many and tally(here, 0) < few_pages * len(children):
                merged = "*"
            elif len(children) > 1 and g + b and abs(smooth(g, b, pooled) - pooled) <= z * spread:
                merged = "~"
            below.setdefault(f"{node}/{merged}", []).extend(xs)
        for following, xs in below.items():
            going = []
            for x in xs:
                parts = x[1].split("/")
                if len(here) == 1:
                    template[x] = "/".join([following, *parts[level + 1:]])
                elif level >= len(parts):
                    template[x] = following
                else:
                    going.append(x)
            if going:
                descend(following, going, level + 1)

    out = {}
    for host in {h for h, _ in leaves}:
        mine = [x for x in leaves if x[0] == host]
        descend("", mine, 1)
        prior = smooth(tally(mine, 1), tally(mine, 2), everything)
        for x in mine:
            same = [y for y in mine if template[y] == template[x]]
            out[x] = template[x], smooth(tally(same, 1), tally(same, 2), prior)
    return out


def test_url_tree_equals_a_direct_version(spark):
    """Deep paths, one hot host, literal * and ~, merged and kept branches."""
    rng = random.Random(5)
    urls = []
    for i in range(900):
        host = "hot.com" if i % 3 else rng.choice(["a.org", "b.com", "c.net", ""])
        parts = [rng.choice(["de", "fr", "en", "*", "~", "\\*", ""]) for _ in range(rng.randrange(4))]
        parts += rng.choice([[], ["deep"] * 8, [f"x{rng.randrange(400)}"], ["p", f"y{rng.randrange(60)}", "q"]])
        kind = parts[0] if parts else ""
        verdict = {"de": "block", "fr": "allow"}.get(kind) if rng.random() < 0.8 else rng.choice(["allow", "block", None])
        urls.append((host, "".join("/" + s for s in parts), verdict))
    df = spark.createDataFrame(urls, "host string, look string, verdict string")
    rows = urlfilter.template_tree(df, Scratch(spark, "t")).collect()
    want = tree_brute(urls)
    assert {(r["host"], r["look"]): r["template"] for r in rows} == {x: t for x, (t, _) in want.items()}
    assert len(rows) == len(want)
    assert all(abs(r["share"] - want[r["host"], r["look"]][1]) < 1e-9 for r in rows)
    kinds = {t.split("/")[i] for t, _ in want.values() for i in range(1, t.count("/") + 1)}
    assert {"*", "~"} <= kinds and any(k.startswith("\\") for k in kinds)
    assert sum(r["_n"] for r in rows) == len(urls)


def test_url_deep_numbers_share_a_template(spark):
    df = spark.createDataFrame([(i, f"http://h.net/a/b/c/d/e/f/{i}/x{i}y", "") for i in range(30)], PAGES)
    assert {r["template"] for r in urlfilter.judge_urls(df).collect()} == {"/a/b/c/d/e/f/<n>/*/"}


def test_url_empty(spark):
    assert urlfilter.judge_urls(spark.createDataFrame([], PAGES)).collect() == []
