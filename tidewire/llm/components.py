"""Consolidating pairwise matches into groups (problem 4): alternating large-star and small-star.

Nodes are numbered once, so the rounds move pairs of integers. Each round rewrites the edges with one shuffle: large-star links a node's
larger neighbours to the smallest node around it, small-star its smaller ones. The minimum comes from a plain aggregation that
is joined back, so no neighbourhood is ever collected, however large; AQE splits the hot keys of that
join. Rounds end when the edge set no longer changes, which a count and a sum of hashes show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_THRESHOLD = 0.78


def clean_id(c: Column) -> Column:
    trimmed = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.when(trimmed != "", trimmed)


def linking_pairs(pairs: DataFrame, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(u, v), u < v, once for each pair of topics of which some row's current is a number of at least its threshold."""
    a, b = clean_id(F.col("topic_id_a")), clean_id(F.col("topic_id_b"))
    score = F.col("current")
    good = score.isNotNull() & ~F.isnan(score) & (score >= F.coalesce(F.nanvl("threshold", F.lit(default)), F.lit(default)))
    rows = pairs.where(good).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), (a != b).alias("__ok"), a.isNotNull().alias("__a"), b.isNotNull().alias("__b"))
    return rows.where("__ok and __a and __b").select("u", "v").dropDuplicates(["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u < v; the result has them too. A star is centred at every node."""
    if large:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
    else:
        around = edges.select(F.col("v").alias("n"), F.col("u").alias("x"))
    least = around.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
    moved = around.join(least, "n")
    if large:
        out = moved.where(F.col("x") > F.col("n")).select(F.col("m").alias("u"), F.col("x").alias("v"))
    else:
        # smaller neighbours, and the node itself, go to the smallest
        out = moved.select(F.col("m").alias("u"), F.col("x").alias("v")).unionByName(least.select(F.col("m").alias("u"), F.col("n").alias("v")))
    return out.where("u <> v").dropDuplicates(["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_groups(edges: DataFrame) -> DataFrame:
    """(node, group_id) for each node of the edges (u, v); group_id is the smallest node of the component. No edges, no rows."""
    given = cut_lineage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").dropDuplicates(["u", "v"]))
    # kept, as a number must stay the same for all who read it
    numbered = cut_lineage(given.select(F.col("u").alias("node")).union(given.select("v")).dropDuplicates(["node"]).withColumn("n", F.monotonically_increasing_id()))
    name = lambda side, out: numbered.select(F.col("node").alias(side), F.col("n").alias(out))
    ends = given.join(name("u", "x"), "u").join(name("v", "y"), "v")
    now = cut_lineage(ends.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))
    state = _state(now)
    # the sum of all ends falls with every round that changes anything, so this ends
    while True:
        now = cut_lineage(_star(_star(now, large=True), large=False))
        before, state = state, _state(now)
        if before == state:
            break
    # settled: every edge leads from a component's centre to one other member
    members = now.select(F.col("v").alias("n"), F.col("u").alias("centre")).unionByName(now.select(F.col("u").alias("n"), F.col("u").alias("centre")).dropDuplicates(["n"]))
    named = members.join(numbered, "n").select("node", "centre")
    return named.join(named.groupBy("centre").agg(F.min("node").alias("group_id")), "centre").select("node", "group_id")


def topic_groups(pairs: DataFrame, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    return connected_groups(linking_pairs(pairs, default)).select(F.col("node").alias("topic_id"), "group_id")
