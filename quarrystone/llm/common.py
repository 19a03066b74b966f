"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every contract here: space and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
#: About the bytes of an Arrow batch once ``small_batches`` was called; an executor and its Python workers hold several of them a core.
BATCH_BYTES = 3 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves 2 modulo 4; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(spark: SparkSession) -> None:
    """From now on the session's tasks hand texts to Python in batches of about BATCH_BYTES.

    Spark's own bound is 64 MiB and 10,000 rows.  A bound that the user set is
    kept.  The rows are the same; only their batches are smaller.
    """
    if spark.conf.get(_BATCH, "64m") in ("64m", "67108864b"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Return what this process has freed to the system; Spark keeps a worker for later tasks, and its memory with it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], text: str, most_rows: int = 1024, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds little text at a time; after the last, freed memory is given back."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, min(start + most_rows, int(np.searchsorted(sizes, before + most_bytes, "right"))))
            yield batch.slice(start, stop - start)
            start = stop
    batch = None
    give_back()
