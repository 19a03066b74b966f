"""Connected components of an edge table, without any driver-side links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.tables import cut_lineage, join_hot


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("hi", "lo") % 1_000_003), F.lit(0)).alias("s")).first()
    return row.n, row.s


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's least node.

    Alternates the large-star and small-star contractions of Kiveris et al.
    ("Connected Components in MapReduce and Beyond", 2014) until the edge set
    is a forest of stars.  Each step is a partially aggregated minimum and a
    join in which the edges of hubs meet their minimum by broadcast, so a hub
    never has its neighbours gathered in one task.
    Nulls and self-loops are ignored; an empty table gives an empty table.
    """
    a, b = F.col(left), F.col(right)
    stars = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    stars = cut_lineage(stars)
    before = _signature(stars)
    if before[0] == 0:
        return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    for _ in range(max_rounds):
        both = stars.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("lo").alias("v")))).alias("e"))
        lowest = both.groupBy(F.col("e.u").alias("lo")).agg(F.min("e.v").alias("m"), F.count("*").alias("c"))
        large = join_hot(stars, lowest, ["lo"], "c", before[0]).select("hi", F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("c"))
        joined = join_hot(large, least, ["hi"], "c", before[0])
        small = joined.select(
            F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")
        ).select("e.hi", "e.lo").where("hi != lo").distinct()
        stars = cut_lineage(small)
        after = _signature(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
