"""Near pairs of many vectors: packed blocks meet in pairs, and a task multiplies one block by another.

Every vector is compared with every other one, so no pair is missed.  Blocks
are written once and read again by each task, so neither vectors nor pairs are
shuffled: the disk holds the vectors once, and the links that are found.  The
work grows with the square of the rows; memory is bounded by two blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.tables import cut_lineage

#: Vectors of a block, pairs that are looked at together, vectors that are multiplied at once, and parts that even a small table is dealt into.
BLOCK, SCORES, TILE, PARTS = 32768, 1 << 22, 2048, 6
#: Scores so near the threshold are computed again in doubles, summed in the order of the values.
_SLACK = 1e-5
_PACKED = "block long, ids binary, kind string, vectors binary"
#: Marks of a found row: a pair, a pair of rows that both have enough neighbours, a row that has.
PAIR, JOINED, FULL = 0, 1, 2


def _pack(size: int):
    """Blocks of rows (id, payload), in floats if those hold the values and in doubles if not."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held = TaskContext.get().partitionId() << 32, {"<f4": [], "<f8": []}

        def block(kind: str, stop: int) -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            ids, rows = (np.concatenate(x) for x in zip(*held[kind]))
            held[kind] = [(ids[stop:], rows[stop:])]
            own = [serial, ids[:stop].astype("<i8").tobytes(), kind, rows[:stop].astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, (pa.int64(), pa.binary(), pa.string(), pa.binary()))], ["block", "ids", "kind", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows = batch.column("id").to_numpy(), batch.column("payload").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            single = (rows.astype(np.float32) == rows).all(1)
            for kind, some in (("<f4", single), ("<f8", ~single)):
                held[kind].append((ids[some], rows[some]))
                while sum(len(x) for x, _ in held[kind]) >= size:
                    yield block(kind, size)
        for kind in held:
            if sum(len(x) for x, _ in held[kind]):
                yield block(kind, size)

    return run


class _Side:
    """A block's vectors, and the same of length one in floats; what has no length has a direction of its own."""

    def __init__(self, ids: pa.Scalar, kind: str, vectors: pa.Scalar):
        self.ids = np.frombuffer(ids.as_buffer(), "<i8")
        self.raw = np.frombuffer(vectors.as_buffer(), kind).reshape(len(self.ids), -1)
        rows = self.raw.astype(np.float64)
        size = np.sqrt((rows * rows).sum(1))
        rows /= np.where(size > 0, size, 1.0)[:, None]
        self.unit = np.c_[rows.astype(np.float32), (size == 0).astype(np.float32)]


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.add.accumulate(a.astype(np.float64) * b.astype(np.float64), axis=1)[:, -1]


def _hits(x: _Side, y: _Side, same: bool, least: float, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``x`` and in ``y`` of the near pairs, for some rows of ``x`` at a time; a block with itself gives each pair once."""
    step = max(1, SCORES // len(y.ids))
    tiles = [(c, np.ascontiguousarray(y.unit[c : c + TILE].T)) for c in range(0, len(y.ids), TILE)]
    for at in range(0, len(x.ids), step):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for start, tile in tiles:
            if same and start + tile.shape[1] <= at:
                continue
            scores = x.unit[at : at + step] @ tile
            if not scores.max() < least - _SLACK:
                row, col = np.nonzero(scores >= least - _SLACK)
                found.append((row + at, col + start, scores[row, col].astype(np.float64)))
        row, col, value = (np.concatenate(f) for f in zip(*found))
        unsure = np.flatnonzero((np.abs(value - least) <= _SLACK) & ((row < col) | (not same)))
        for part in np.array_split(unsure, len(unsure) // 4096 + 1):
            a, b = x.raw[row[part]], y.raw[col[part]]
            value[part] = _in_order(a, b) / np.sqrt(_in_order(a, a) * _in_order(b, b))
        good = value > least if strict else value >= least
        if same:
            good &= row < col
        if good.any():
            yield row[good], col[good]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let the least place stand for all places that the pairs connect."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _met(least: float, strict: bool, need: int):
    """Links of pairs of blocks, at most ``need`` + 2 rows for each vector of a pair.

    A row with ``need`` near ones in the other block is full.  A pair of two
    full ones only connects them, which one link for each tells as well; all
    others are given, so of what is full nowhere every pair is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x, y = (_Side(batch.column(s + "ids")[at], batch.column(s + "kind")[at].as_py(), batch.column(s + "vectors")[at]) for s in ("a_", "b_"))
                same = batch.column("a_block")[at] == batch.column("b_block")[at]
                after = 0 if same else len(x.ids)
                ids = x.ids if same else np.concatenate([x.ids, y.ids])
                root, full, seen, out = np.arange(len(ids)), np.zeros(len(ids), bool), np.zeros(len(y.ids), np.int64), []
                for row, col in _hits(x, y, same, least, strict):
                    both = np.ones(len(row), bool)
                    if need:
                        own = np.bincount(row, minlength=len(x.ids))
                        full[np.flatnonzero(own >= need)] = True
                        order = np.argsort(col, kind="stable")
                        first = np.r_[True, np.diff(col[order]) > 0]
                        place = np.empty(len(col), np.int64)
                        place[order] = np.arange(len(col)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                        both = (own[row] >= need) & (place + seen[col] >= need)
                        seen += np.bincount(col, minlength=len(seen))
                        out.append((ids[row[~both]], ids[col[~both] + after], PAIR))
                    _join(root, row[both], col[both] + after)
                if need:
                    full[np.flatnonzero(seen >= need) + after] = True
                    out.append((ids[full], ids[full], FULL))
                moved = np.flatnonzero(root != np.arange(len(root)))
                out.append((ids[moved], ids[root[moved]], JOINED))
                for a, b, what in out:
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), what, np.int32))], ["a", "b", "what"])

    return run


def near_links(rows: DataFrame, least: float, strict: bool = False, need: int = 0) -> DataFrame:
    """(a, b, what) of the vectors (id, payload) of cosine ``least`` or more (above it, if ``strict``).

    With no ``need`` all links are JOINED: they connect whatever near pairs
    connect.  Else every near pair of two rows is a PAIR, unless both are FULL
    (have ``need`` near ones or more), when JOINED links connect them.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("payload").cast("array<double>").alias("payload"))
    n = rows.count()
    parts = max(PARTS, -(-n // BLOCK))
    size = max(1, min(BLOCK, -(-n // parts)))
    blocks = cut_lineage(rows.coalesce(parts).mapInArrow(_pack(size), _PACKED))
    if blocks.select(F.spark_partition_id()).distinct().count() < parts:
        blocks = blocks.repartition(parts)
    side = lambda s: blocks.select(*[F.col(c).alias(s + c) for c in blocks.columns])
    pairs = side("a_").crossJoin(side("b_")).where("a_block <= b_block")
    return cut_lineage(pairs.mapInArrow(_met(least, strict, need), "a long, b long, what int"))
