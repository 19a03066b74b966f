"""Quality rules: counted facts and a hashed n-gram log-likelihood ratio, all in SQL expressions.

The ratio compares two multinomials over ``buckets`` hash slots of word
n-grams (n = 1, 2; whole words, so that case and trailing marks stay): the
trusted documents' and the whole corpus's, both counted over every document and smoothed by one.  A document's score is the
mean of log2(p_trusted / p_raw) over its n-grams, summed in fixed-point
integers, so that the order of addition cannot change a verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import SPACES, words
from quarrystone.operators import tables
from quarrystone.operators.tables import cut_lineage, table_bytes

BUCKETS, SCALE = 1 << 14, 1 << 16
#: Least mean log2 ratio of a document that is kept.
LEAST_RATIO = -0.25
#: Least words, and most percent of words in repeated windows, of the base rules.
LEAST_WORDS, MOST_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"


def _facts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(doc_id).alias("id"), t.alias("t"), words(F.col(text)).alias("w"))
    out = out.select(
        "id", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
    )
    three = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    out = out.withColumn("three", F.when(F.col("n_words") >= 3, three).otherwise(F.array().cast("array<bigint>"))).drop("lines")
    # only texts with a repeated window pay for the sort that finds where the repeats stand
    repeats = F.size(F.array_distinct("three")) < F.size("three")
    placed = F.sort_array(F.transform("three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("placed", F.when(repeats, placed)).drop("three")

    def twin(x: Column, i: Column) -> Column:
        before, after = F.get("placed", i - 1)["h"], F.get("placed", i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    out = out.withColumn("spots", F.sort_array(F.transform(F.filter("placed", twin), lambda x: x["i"]))).drop("placed")
    spans = F.transform("spots", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("spots", i + 1) - p, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("spots")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def ngram_hashes(w: str) -> Column:
    """Hashes of the one- and two-word n-grams of the word array."""
    ones = F.transform(w, lambda x: F.xxhash64(x))
    pairs = F.greatest(F.size(w) - 1, F.lit(0))
    twos = F.zip_with(F.slice(ones, 1, pairs), F.slice(ones, 2, pairs), lambda a, b: F.xxhash64(a, b))
    return F.concat(ones, twos)


def _slot(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def ratio_table(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """log2(p_trusted / p_raw) of each slot in units of 1/SCALE, counted over all documents.

    ``trusted`` has the ids of the target documents.  The driver gets
    ``buckets`` pairs of counts, whatever the size of the corpus.
    """
    ids = cut_lineage(trusted.select(F.col(doc_id).alias("id")).where("id IS NOT NULL").distinct().withColumn("good", F.lit(1)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    if table_bytes(ids) <= tables.BROADCAST_BYTES:
        rows = rows.join(F.broadcast(ids), "id", "left")
    else:  # null ids, which may be many, are not shuffled to one task
        rows = rows.where("id IS NOT NULL").join(ids, "id", "left").unionByName(rows.where("id IS NULL").withColumn("good", F.lit(None).cast("int")))
    rows = rows.select("good", words(F.col("t")).alias("w"))
    slots = rows.select("good", F.explode(ngram_hashes("w")).alias("h")).select("good", _slot(F.col("h"), buckets).alias("b"))
    raw, good = [1] * buckets, [1] * buckets
    for r in slots.groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("good")).collect():
        raw[r.b] += r.raw
        good[r.b] += r.good
    total_raw, total_good = sum(raw), sum(good)
    if total_good == buckets:  # nothing is trusted, so nothing is told apart
        return [0] * buckets
    return [round(SCALE * math.log2(g * total_raw / (r * total_good))) for r, g in zip(raw, good)]


def quality_rules(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, mean_ratio) of every row.

    A null text has no word and fails the base rules.  Rows of null or equal
    id are each judged.  Without trusted documents every ratio is 0 and all
    that pass the base rules stay; a ratio equal to the threshold stays.
    Very long texts cost their number of words.  An empty table gives an empty
    result.  No other column is read.  The few numbers of each row are written to the
    shared folder, so that no later filter reaches into their expressions.
    """
    table = ratio_table(docs, trusted, doc_id, text, buckets)
    known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    out = _facts(docs, doc_id, text).withColumn("grams", ngram_hashes("w")).drop("w")
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, h: a + F.get(known, _slot(h, buckets)))
    out = out.withColumn("sum", total).withColumn("n", F.size("grams"))
    fair = F.col("sum") >= F.floor(F.lit(least_ratio * SCALE)).cast("long") * F.col("n")
    ratio = F.when(F.col("n") > 0, F.col("sum") / F.col("n") / SCALE).otherwise(F.lit(0.0))
    out = out.select(
        F.col("id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & fair).alias("kept"), ratio.alias("mean_ratio"),
    )
    return cut_lineage(out)
