"""Interval joins without bins to tune: an interval is a few dyadic cells, a point is in one cell of each level."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.similar import bucket_pairs
from quarrystone.operators.tables import cut_lineage


def dyadic_cells(low: int, high: int) -> list[tuple[int, int]]:
    """(level, cell): the fewest cells of 2 ** level numbers that together are low to high; two a level at most."""
    out, level, stop = [], 0, high + 1
    while low < stop:
        if low & 1:
            out.append((level, low))
            low += 1
        if stop & 1:
            stop -= 1
            out.append((level, stop))
        low, stop, level = low >> 1, stop >> 1, level + 1
    return out


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, low, high, level, cell) for i, low, high in zip(*[batch.column(c).to_pylist() for c in ("id", "low", "high")]) for level, cell in dyadic_cells(low, high)]
        columns = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("id").type, *[pa.int64()] * 4))], ["id", "low", "high", "level", "cell"])


def contained(spans: DataFrame, segments: DataFrame, chunk: int = 2048) -> DataFrame:
    """(id, segment) for each segment (segment, start, stop) that lies within a span (id, low, high); bounds are longs and belong to them.

    A span's cells are disjoint, so a segment's start meets a span once at
    most, however long the span; its stop is compared then.  Only levels that
    some span uses are looked at, 63 at most.  Cells that many spans and
    segments share are dealt out in pairs of chunks.  Nulls, and spans that end
    before they begin, hold nothing.
    """
    able = spans.where("low IS NOT NULL AND high IS NOT NULL AND low <= high").select("id", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    cells = cut_lineage(able.mapInArrow(_cells, f"id {dict(spans.dtypes)['id']}, low long, high long, level long, cell long"))
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # 63 at most
    if not levels:
        return able.select("id").crossJoin(segments.select("segment").limit(0)).limit(0)
    key = lambda level, cell: F.xxhash64(level, cell)
    spots = F.array(*[F.struct(F.lit(n).cast("long").alias("level"), F.shiftright("start", n).alias("cell")) for n in levels])
    points = segments.where("start IS NOT NULL AND stop IS NOT NULL").select("segment", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    points = points.select("segment", "stop", F.explode(spots).alias("s")).select(key(F.col("s.level"), F.col("s.cell")).alias("bucket"), "segment", "stop", F.col("s.level").alias("own_level"), F.col("s.cell").alias("own_cell"))
    held = points.join(cells.select(key(F.col("level"), F.col("cell")).alias("bucket")).distinct(), "bucket", "left_semi")
    met = bucket_pairs(cells.select(key(F.col("level"), F.col("cell")).alias("bucket"), "id", "high", "level", "cell"), held, chunk)
    return met.where("level = own_level AND cell = own_cell AND stop <= high").select("id", "segment")
