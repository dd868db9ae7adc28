"""Connected components of a link table, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, label: str = "links") -> DataFrame:
    """(node, component) of every node that has a link: component is the
    smallest node reachable.

    Alternating large-star and small-star steps over (u, v): every step hangs
    nodes under the smallest neighbour known, and O(log n) rounds leave one
    star per component.  Each round is a written table, so lineage stays
    short; a hub's rows meet a unique side in every join, which the engine can
    split.
    """
    pair = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, turn, seen = scratch.write(pair, f"{label}0"), 0, None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"),
                         F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = scratch.write(large, f"{label}{turn}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.select("u", F.col("m").alias("v"))
                 .unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        turn += 1
        edges = scratch.write(small, f"{label}{turn}")
        scratch.drop(f"{label}{turn - 1}", f"{label}{turn - 1}-large")


def with_components(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) with the known components of both ends, ca and cb (their
    own name if they have none)."""
    for end in ("a", "b"):
        side = known.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(side, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs


def extended(known: DataFrame, links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``known`` components after more links: only components that a link
    joins take part, under their names."""
    between = scratch.write(with_components(links, known).filter("ca <> cb")
                            .select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), f"{label}between")
    if not between.limit(1).count():
        return known
    merged = components(between, scratch, label)
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    old = known.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return scratch.write(old.unionByName(merged.join(known, "node", "left_anti")), f"{label}extended")
