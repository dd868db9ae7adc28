"""URL verdicts from rules and a path-template tree (operator 10, native).

Rules decide the URLs they fit and label them.  All URLs are generalised into
templates: first by the look of a segment (numbers, long ids), then down a
tree per host, level by level: a node with many children of few pages each
turns them into one wildcard, and siblings whose labelled share does not
differ significantly from their parent's merge into one branch.  A template
is rejected when its smoothed share of allowed pages is too low; the share is
smoothed towards its host's, and that towards the whole table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import Scratch, join_on_hot_key, pick

# (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return rule, verdict


def looks(path: Column) -> Column:
    """Path with segments that vary by their look generalised."""
    out = F.regexp_replace(path, r"(?<=/)[0-9]+(?=[/.]|$)", "<n>")
    out = F.regexp_replace(out, r"(?<=/)[0-9]{4}-[0-9]{2}(-[0-9]{2})?(?=[/.]|$)", "<date>")
    out = F.regexp_replace(out, r"(?<=/)(?=[^/]*[0-9])[0-9A-Fa-f-]{8,}(?=[/.]|$)", "<hex>")
    return F.regexp_replace(out, r"(?<=/)(?=[^/]*[0-9])[0-9A-Za-z_-]{12,}(?=[/.]|$)", "<id>")


def _join_at(left: DataFrame, right: DataFrame, names: list[str], n: str, total: int) -> DataFrame:
    """Join on several columns, of which a value may be hot: ``right`` is a
    written table, unique on them, with the number of left rows in ``n``."""
    key = F.struct(*[F.col(c) for c in names])
    return join_on_hot_key(left.withColumn("_at", key), right.withColumn("_at", key).drop(*names), "_at", n=n,
                           total=total).drop("_at", n)


def template_tree(urls: DataFrame, scratch: Scratch, many: int = 10, few_pages: float = 3.0, strength: float = 4.0,
                  z: float = 2.0) -> DataFrame:
    """Leaves of the tree over (host, look, verdict or null): one row per
    (host, look) with its template and the smoothed share of allowed pages.

    The tree is as deep as two looks of a host go together: a leaf that is
    alone in its node, or at its end, has its template.  The end of a path is a
    child like any other, an empty segment: templates of nodes that several
    looks reach together end in a slash.
    """
    good, bad = (F.sum((F.col("verdict") == v).cast("long")) for v in ("allow", "block"))
    leaves = urls.groupBy("host", "look").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(good, F.lit(0)).alias("good"), F.coalesce(bad, F.lit(0)).alias("bad"))
    nodes = scratch.write(leaves.withColumn("segments", F.split(F.col("look"), "/")).withColumn("node", F.lit("")),
                          "level0")
    whole = nodes.agg(((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 2)).alias("all_share"))
    # a literal segment that looks like a merged one gets a mark
    literal = F.regexp_replace("seg", r"^(\\*[*~])$", r"\\$1")

    def share(good: str, bad: str, prior: str) -> Column:
        return (F.col(good) + strength * F.col(prior)) / (F.col(good) + F.col(bad) + strength)

    level, open_leaves, done = 0, nodes.count(), []
    while open_leaves:
        level += 1
        here = nodes.withColumn("seg", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        children = scratch.write(here.groupBy("host", "node", "seg").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("pages"), F.sum("good").alias("g"),
            F.sum("bad").alias("b")), f"children{level}")
        parents = scratch.write(children.groupBy("host", "node").agg(
            F.count(F.lit(1)).alias("n_kids"), F.sum("rows").alias("leaves"), F.sum("pages").alias("all_pages"),
            F.sum("g").alias("pg"), F.sum("b").alias("pb")).withColumn("kids", F.col("n_kids")), f"parents{level}")
        judged = (_join_at(children, parents, ["host", "node"], "n_kids", open_leaves).join(F.broadcast(whole))
                  .withColumn("pooled", share("pg", "pb", "all_share"))
                  .withColumn("own", share("g", "b", "pooled"))
                  .withColumn("spread", F.sqrt(F.col("pooled") * (1 - F.col("pooled")) / (F.col("g") + F.col("b") + strength))))
        variable = (F.col("kids") >= many) & (F.col("all_pages") < few_pages * F.col("kids"))
        alike = (F.abs(F.col("own") - F.col("pooled")) <= z * F.col("spread")) & (F.col("g") + F.col("b") > 0)
        step = scratch.write(judged.select(
            "host", "node", "seg", "rows", (F.col("leaves") == 1).alias("alone"),
            F.concat("node", F.lit("/"), F.when(variable, F.lit("*")).when(alike & (F.col("kids") > 1), F.lit("~"))
                     .otherwise(literal)).alias("next")), f"steps{level}")
        rest = F.array_join(F.slice("segments", level + 2, F.size("segments")), "/")
        # the level's leaves: those alone take the rest of their path as it is
        last = F.col("alone") | (F.lit(level) >= F.size("segments"))
        whole_path = F.when(F.col("alone") & (F.size("segments") > level + 1), F.concat("next", F.lit("/"), rest)) \
            .otherwise(F.col("next"))
        placed = scratch.write(_join_at(here, step, ["host", "node", "seg"], "rows", open_leaves).select(
            "host", "look", "_n", "good", "bad", "segments", whole_path.alias("node"), last.alias("last")),
            f"level{level}")
        done.append(placed.filter(F.col("last")).drop("last", "segments"))
        nodes = placed.filter(~F.col("last")).drop("last")
        open_leaves = nodes.count()
        scratch.drop(f"children{level}", f"parents{level}", f"steps{level}")
    if not done:
        return nodes.select("host", "look", "_n", F.col("node").alias("template"), F.lit(0.0).alias("share"))
    ended = done[0]
    for part in done[1:]:
        ended = ended.unionByName(part)
    ended = scratch.write(ended, "ended")
    templates = scratch.write(ended.groupBy("host", "node").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("good").alias("g"), F.sum("bad").alias("b")), "templates")
    hosts = scratch.write(templates.groupBy("host").agg(
        F.count(F.lit(1)).alias("in_host"), F.sum("g").alias("hg"), F.sum("b").alias("hb")), "hosts")
    scored = scratch.write(
        _join_at(templates, hosts, ["host"], "in_host", templates.count()).join(F.broadcast(whole))
        .withColumn("host_share", share("hg", "hb", "all_share"))
        .select("host", "node", "rows", share("g", "b", "host_share").alias("share")), "scored")
    scratch.drop(*[f"level{i}" for i in range(level + 1)], "templates", "hosts")
    return _join_at(ended, scored, ["host", "node"], "rows", ended.count()).select(
        "host", "look", "_n", F.col("node").alias("template"), "share")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, least_share: float = 0.5) -> DataFrame:
    """Verdict of every page's URL: (page_id, host, path, rule, verdict,
    template, share).

    A null URL or one without "://" has an empty host and path and is judged by
    the template of such URLs.  Repeated rows get a row each; an empty table
    gives no rows; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    parsed = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"),
                                                  path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = parsed.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("look", looks(F.col("path")))
    key = F.concat_ws(" ", "host", "look")
    tree = template_tree(urls.select("host", "look", "verdict"), scratch).select(
        key.alias("key"), "template", "share", "_n")
    tree = scratch.write(tree, "tree")
    total = tree.agg(F.sum("_n")).first()[0] or 0
    joined = join_on_hot_key(urls.withColumn("key", key), tree, "key", total=total)
    method = F.when(F.col("share") < least_share, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"),
                         "template", "share")
