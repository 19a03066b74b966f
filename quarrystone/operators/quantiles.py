"""Exact quantiles of groups of any size, by ranges of the values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.tables import cut_lineage, free_names, near, reduce_rows


def exact_quantiles(rows: DataFrame, key: str, value: str, marks: dict[str, float]) -> DataFrame:
    """(key, n, and a column for each of ``marks``): quantiles of each key's values, linear between neighbours; n counts null values too, which have no rank.

    Different values are counted and dealt by ranges of (key, value), so a
    key with most of the rows is many tasks; what a task needs to know of the
    others is one count a key and range.
    """
    part, c, ranked, before, total, upto = free_names(rows, "range_part", "c", "ranked", "before", "total", "upto")
    counts = rows.groupBy(key, value).agg(F.count("*").alias(c)).withColumn(ranked, F.when(F.col(value).isNotNull(), F.col(c)).otherwise(0))
    dealt = cut_lineage(counts.repartitionByRange(reduce_rows(rows.sparkSession), key, value).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(F.col(key).alias("k"), F.col(part).alias("p")).agg(F.sum(ranked).alias("s"))
    own = Window.partitionBy("k")
    earlier = own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    known = sizes.select("k", "p", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias(before), F.sum("s").over(own).alias(total))
    placed = dealt.join(near(known), (F.col(part) == F.col("p")) & F.col(key).eqNullSafe(F.col("k"))).withColumn(upto, F.col(before) + F.sum(ranked).over(Window.partitionBy(part, key).orderBy(value)))
    ends = []
    for i, p in enumerate(marks.values()):
        at = (F.col(total) - 1) * F.lit(p)
        for name, rank in ((f"low{i}", F.floor(at)), (f"high{i}", F.ceil(at))):
            ends.append(F.max(F.when((rank < F.col(upto)) & (rank >= F.col(upto) - F.col(ranked)), F.col(value))).alias(name))
    found = placed.groupBy(key).agg(F.sum(c).alias("n"), F.max(total).alias(total), *ends)
    share = lambda p: (F.col(total) - 1) * F.lit(p) - F.floor((F.col(total) - 1) * F.lit(p))
    between = lambda i, p: F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")).otherwise(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * share(p))
    return found.select(key, "n", *[between(i, p).alias(name) for i, (name, p) in enumerate(marks.items())])
