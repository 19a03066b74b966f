"""Walks over graphs and chains of any depth: rounds of joins that end when nothing is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.tables import cut_lineage


def waves(edges: DataFrame, before: str, after: str) -> DataFrame:
    """(node, wave): when each node of a task graph can run, one after its last predecessor; nodes on or behind a cycle never do and are left out."""
    edges = cut_lineage(edges.select(F.col(before).alias("u"), F.col(after).alias("v")).distinct())
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ready = cut_lineage(nodes.join(edges.select(F.col("v").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("wave")))
    done, number, left = ready, 0, edges
    while not ready.isEmpty():
        number += 1
        # edges from what is done are spent; a node without any left is the next wave
        spent = left.join(ready.select(F.col("node").alias("u")), "u", "left_semi").select("v").distinct()
        left = cut_lineage(left.join(ready.select(F.col("node").alias("u")), "u", "left_anti"))
        ready = cut_lineage(spent.join(left.select("v"), "v", "left_anti").select(F.col("v").alias("node"), F.lit(number).alias("wave")))
        done = done.unionAll(ready)
    return done


def chain_lengths(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, length): links to the first cause, by pointer doubling, so a chain of n links takes log2(n) rounds.

    A node whose parent is null or not listed is a first cause, of length 0;
    nodes on or behind a cycle are left out.
    """
    known = links.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    state = known.join(known.select(F.col("node").alias("up"), F.lit(True).alias("there")), "up", "left")
    state = cut_lineage(state.select("node", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("length")))
    total, reach = state.count(), 1
    while reach <= 2 * total and not state.where("up IS NOT NULL").isEmpty():
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("length").alias("more"))
        state = cut_lineage(state.join(far, "up", "left").select("node", F.col("up2").alias("up"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")))
        reach *= 2
    return state.where("up IS NULL").select("node", "length")


def repeated_callers(calls: DataFrame, call: str, parent: str, agent: str) -> DataFrame:
    """(call, distance): calls whose agent stands above them in their own chain already, and how many calls above the nearest."""
    known = cut_lineage(calls.select(F.col(call).alias("call"), F.col(parent).alias("parent"), F.col(agent).alias("agent")))
    above = known.select(F.col("call").alias("at"), F.col("parent").alias("next"), F.col("agent").alias("seen"))
    front, found, distance = known.select("call", "agent", F.col("parent").alias("at")), known.limit(0).select("call", F.lit(0).alias("distance")), 0
    total = known.count()
    while distance <= total:
        distance += 1
        met = cut_lineage(front.join(above, "at"))
        if met.isEmpty():
            break
        found = found.unionAll(met.where("agent = seen").select("call", F.lit(distance).alias("distance")))
        front = met.where("agent <> seen AND next IS NOT NULL").select("call", "agent", F.col("next").alias("at"))
    return found
