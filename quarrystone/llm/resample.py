"""Importance resampling towards a target distribution of hashed n-grams, with buckets from a ring of running CRC states."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, raw_texts
from quarrystone.operators.tables import by_keys, cut_lineage, numbered

#: Longest run of words, number of buckets, and the seed of the draw.
RUN, BUCKETS, SEED = 3, 10000, 42
#: Only A-Z are lowered; other ASCII that is no digit or letter separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SLICE, _HELD = 1 << 20, 1 << 16


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte of it at a time."""
    start = 0
    while start < len(text):
        stop = text.find(b" ", start + _SLICE) if start + _SLICE < len(text) else -1
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


def feature_hashes(text: bytes, run: int = RUN) -> Iterator[np.ndarray]:
    """CRC-32 of every run of 1 to ``run`` words joined by a space, in one scan of the text; arrays of bounded size.

    The ring holds the state of the runs that began at each of the last words;
    a word extends each by a space and itself, and begins one of its own.
    """
    ring: list[int] = []
    out: list[int] = []
    for words in _slices(text.translate(_WORD_BYTES)):
        for word in words:
            joined = b" " + word
            ring = [crc32(word), *[crc32(joined, state) for state in ring]]
            out += ring
            if len(ring) == run:
                ring.pop()
        if len(out) >= _HELD:
            yield np.array(out, np.uint32)
            out = []
    if out:
        yield np.array(out, np.uint32)


def word_count(features: int, run: int = RUN) -> int:
    """How many words a text of so many features has: n words have n + (n - 1) + ... of them."""
    for n in range(run):
        if features == n * (n + 1) // 2:
            return n
    return (features + run * (run - 1) // 2) // run


def bucket_counts(texts: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) of all features of all texts; a task gives one row for each bucket it met."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches, "text"):
            for raw in raw_texts(piece.column("text")):
                for hashes in feature_hashes(raw, run):
                    total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "count"])

    each = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, count long")
    return each.groupBy("bucket").agg(F.sum("count").alias("count"))


def log_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw texts.

    The counts of ``bucket_counts`` are one number a bucket, so at most
    ``buckets`` rows of each reach the driver.
    """
    held = []
    for side in (raw, target):
        counts = [0] * buckets
        for row in side.collect():
            counts[row["bucket"]] = row["count"]
        held.append(counts)
    s, t = held
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log(float((b + 1) * all_s) / float((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def draw_score(doc_id: int | str | None, weight: int, seed: int = SEED) -> int:
    """``weight`` and the Gumbel noise of the document, in thousandths; the noise depends on seed and id only."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row: the sum of its features' gains, and that with the noise."""
    buckets = np.uint32(len(gains))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            ids, features, weights = piece.column("id").to_pylist(), [], []
            for raw in raw_texts(piece.column("text")):
                n, weight = 0, 0
                for hashes in feature_hashes(raw, run):
                    n += len(hashes)
                    weight += int(gains[hashes % buckets].sum())
                features.append(n)
                weights.append(weight)
            scores = [draw_score(name, weight, seed) for name, weight in zip(ids, weights)]
            counts = [word_count(n, run) for n in features]
            yield pa.RecordBatch.from_arrays([piece.column("id"), *[pa.array(c, pa.int64()) for c in (counts, features, weights, scores)]], ["id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(score, f"id {dict(rows.dtypes)['id']}, n_words long, n_features long, weight long, score long")
    return scored.withColumnRenamed("id", doc_id)


def resample_ranks(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 5, least_words: int = 20, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; rows that are not drawn have a null rank.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred of
    the highest scores are drawn: a sample without replacement whose odds are
    the documents' likelihood under the target against that under ``docs``.
    Ties go to the smaller id, a null id before all; repeated rows tie and each
    takes a rank.  Null and empty texts have no features and weight 0, texts of
    any length count whole, other columns are passed over, and empty tables
    give empty results or gains of no target.  ``docs`` is scanned twice; what
    is kept of it is one number a bucket, and then five a row.
    """
    gains = log_gains(bucket_counts(docs, text, run, buckets), bucket_counts(target, target_text, run, buckets), buckets)
    scored = cut_lineage(score_documents(docs, gains, doc_id, text, run, seed))
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    ranked = numbered(scored.where(able).withColumn("minus", -F.col("score")), ["minus", doc_id, "weight", "n_features"], "rank").drop("minus")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def draw_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that ``resample_ranks`` draws, with all their columns; ids must be unique."""
    ranks = resample_ranks(docs, target, doc_id, text, **more).where("rank IS NOT NULL").select(F.col(doc_id).alias("drawn"), F.lit(1).cast("long").alias("rows"))
    return by_keys(docs, cut_lineage(ranks), {"drawn": F.col(doc_id)}, "rows", 1 << 62, True)
