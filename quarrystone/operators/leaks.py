"""Documents that hold much of an item word for word, by hashed runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.tables import cut_lineage, near


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def _runs(hashes: Column, size: Column, length: Column) -> Column:
    """The distinct hashes of the runs of ``length`` words of a text of ``size``."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), size - length + 1), lambda i: F.xxhash64(length, F.slice(hashes, i, length))))


def run_share(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, length: int = 8, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, share) where ``share`` of an item's distinct runs of ``length`` words are in a document, at least ``least``.

    Items of fewer words are one run, all of their words; those without a word
    are in nothing.  A document's runs are numbers that meet the items' at once,
    by broadcast while those are few, so only runs that some item has are
    shuffled.
    """
    own = items.select(F.col(item_id).alias("item"), F.transform(_words(item_text), lambda x: F.xxhash64(x)).alias("h")).withColumn("size", F.size("h")).where("size > 0")
    own = own.withColumn("length", F.least("size", F.lit(length)))
    own = own.select("item", "length", _runs(F.col("h"), F.col("size"), F.col("length")).alias("runs"))
    wanted = cut_lineage(own.select("item", "length", F.size("runs").alias("n"), F.explode("runs").alias("run")))
    lengths = [r.length for r in wanted.select("length").distinct().collect()]  # at most ``length`` different ones
    if not lengths:
        return docs.select(doc_id).limit(0).crossJoin(items.select(item_id, F.lit(0.0).alias("share")).limit(0))
    rows = docs.select(F.col(doc_id).alias("doc"), F.transform(_words(text), lambda x: F.xxhash64(x)).alias("h")).withColumn("size", F.size("h"))
    each = [F.when(F.col("size") >= n, _runs(F.col("h"), F.col("size"), F.lit(n))).otherwise(F.array().cast("array<bigint>")) for n in sorted(lengths)]
    met = rows.select("doc", F.explode(F.concat(*each)).alias("run")).join(near(wanted), "run")
    found = met.groupBy("doc", "item").agg((F.count("*") / F.max("n")).alias("share")).where(F.col("share") >= least)
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "share")
