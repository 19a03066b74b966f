"""Corpus pipeline: toxicity, near-copies, benchmark leaks, mix and token shards, in this order.

``run`` applies the stages to ``documents``; each stage's rows are written as
Parquet to the shared folder and read again before the next.  Null and empty
texts pass the filters as the operators say, and the mix takes no copy of a
text without words.  Rows of null or repeated id are told apart by their text.
A stage that reads texts in Python has them in small batches, a setting that
the session keeps, as Spark reads it when a stage's rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import decontaminate, mixing, simhash, tokens, toxicity
from quarrystone.llm.common import small_batches, table
from quarrystone.llm.registry import LEARN, vocabulary
from quarrystone.operators.tables import delete_dir, fresh_dir


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.3 or more go; it learns from rows that no test holds out."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), LEARN))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints within 3 bits the document of least id stays."""
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.drop_leaks(docs, decontaminate.benchmark_leaks(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every copy that the mix takes."""
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of what is left, read back: (doc_id, start, n_tokens, ids_crc32) of each row."""
    small_batches(spark)
    return tokens.token_round_trip(docs, vocabulary(), end_id=2)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token output", token_output),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            delete_dir(spark, f"{folder}/{number - 1}")
    out = STAGES[-1][1](spark, docs, sf_dir)  # its shards are written, and only they are read later
    delete_dir(spark, folder)
    return out
