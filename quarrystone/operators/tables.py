"""Helpers for tables whose size is not known beforehand: lineage, shared folders, and joins that keep hot keys apart."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    leave it unset; then a temporary folder of this machine is used.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_dir(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``fresh_dir`` named, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have, in the manner of the given ones."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Most bytes of a table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: A key is hot if it has over one row in so many; so fewer keys than this are hot, whatever the data.
HOT = 2000


def table_bytes(small: DataFrame) -> int:
    """About the bytes of the rows: 16 a value, and those of strings and arrays."""
    sizes = F.lit(0).cast("long")
    for field in small.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        more = F.octet_length(column) if kind in ("string", "binary") else F.size(column) * 16 if kind == "array" else F.lit(16 * 3 if kind == "struct" else 0)
        sizes = sizes + 16 + F.coalesce(more, F.lit(0))
    return small.agg(F.coalesce(F.sum(sizes), F.lit(0))).first()[0]


def near(small: DataFrame) -> DataFrame:
    """``small`` with a broadcast hint if its rows are counted to be small enough, else as it is."""
    return F.broadcast(small) if table_bytes(small) <= BROADCAST_BYTES else small


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, spread: int = 4096) -> DataFrame:
    """Inner join on non-null keys that ``right`` has once each, with ``count`` rows of ``left``'s ``total`` each.

    Rows of hot keys, of which there are fewer than HOT, meet ``right`` by
    broadcast, and go through the shuffle that the others need under
    ``spread`` keys of their own; so ``left`` is read once and no key fills a
    task.
    """
    salt, few, many = free_names(left.join(right.limit(0), on), "salt", "few", "many")
    hot, value = F.col(count) * HOT > total, F.struct(*[c for c in right.columns if c not in (*on, count)])
    marked = left.join(F.broadcast(right.where(hot).select(*on, value.alias(few))), on, "left")
    plain = [c for c, kind in left.dtypes if not kind.startswith(("map", "variant"))]
    marked = marked.withColumn(salt, F.when(F.col(few).isNotNull(), F.pmod(F.xxhash64(*plain), F.lit(spread)) + 1).otherwise(F.lit(0).cast("long")))
    rest = right.where(~hot).select(*on, F.lit(0).cast("long").alias(salt), value.alias(many))
    met = marked.join(rest, [*on, salt], "left").where(F.col(few).isNotNull() | F.col(many).isNotNull())
    return met.select(*left.columns, F.coalesce(few, many).alias(few)).select(*left.columns, f"{few}.*")


def by_keys(docs: DataFrame, listed: DataFrame, keys: dict[str, Column], count: str, total: int, kept: bool) -> DataFrame:
    """The rows of ``docs`` whose keys are ``listed`` (if ``kept``; else the others), with their columns; nulls are equal.

    ``listed`` has each key once, with ``count`` rows of ``docs``'s ``total``.
    A list over BROADCAST_BYTES is joined by a shuffle, but for hot keys.
    """
    names = dict(zip(keys, free_names(docs, *keys)))
    own = listed.select(*[F.col(k).alias(v) for k, v in names.items()], F.col(count).alias("rows"))
    same = F.lit(True)
    for k, v in names.items():
        same = same & keys[k].eqNullSafe(F.col(v))
    how = "left_semi" if kept else "left_anti"
    if table_bytes(own) <= BROADCAST_BYTES:
        return docs.join(F.broadcast(own.drop("rows")), same, how)
    hot = F.col("rows") * HOT > total
    few, many = F.broadcast(own.where(hot).drop("rows")), own.where(~hot).drop("rows")
    if not kept:
        return docs.join(few, same, how).join(many, same, how)
    return docs.join(few, same, how).unionByName(docs.join(few, same, "left_anti").join(many, same, how))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number in ``order``, from 1.

    Rows are dealt by ranges of the order; the only step in one task runs over
    one count a partition.
    """
    (part,) = free_names(rows, "range_part")
    dealt = cut_lineage(rows.repartitionByRange(reduce_rows(rows.sparkSession), *order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).count()
    before = sizes.select(part, F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.join(F.broadcast(before), part).withColumn(name, F.col("rows_before") + own).drop(part, "rows_before")


def reduce_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
