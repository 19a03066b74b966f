"""Vector search by inverted lists with product quantisation: nearest cells, scan of codes, exact scores of what is left.

Coarse centres and codebooks are fitted on a bounded sample; every vector is
then put in its nearest centre's list as a code of its residual, with the
length of what the code leaves out.  Lists are blocks of at most LIST_ROWS
vectors, so a crowded cell is many blocks.

With d(q, x) the inner product, d(q, x) <= d(q, centre) + |q| radius for all of
a list, and d(q, x) <= d(q, coded x) + |q| left-out length for each vector.  So
once k vectors are scored exactly, what the bounds put below the k-th of them
need not be read, and the search is exact if the lists left over are scanned
too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators.nearest import _NONE, _keys
from quarrystone.operators.tables import cut_lineage, near, reduce_rows

#: Vectors and bytes that the centres are fitted on, most centres, and vectors in a block.
SAMPLE, SAMPLE_BYTES, MOST_CELLS, LIST_ROWS = 20_000, 64 << 20, 4096, 4096
#: Values a piece of a code takes, and pieces of a code.
CODES, PIECES = 256, 8
#: Cells that are looked at first, as a share of all (so many for vectors without clusters, whose neighbours lie in all directions; clustered ones need a tenth), and vectors of a block that are scored exactly for each one wanted.
PROBE_SHARE, RERANK = 0.7, 8
_SLACK = 2e-5
#: Queries of a block, and the label of a query that takes all.
QUERIES, _ANY = 512, -(1 << 63)
_BLOCKS = "cell int, part long, size int, radius double, ids binary, labels binary, codes binary, errors binary, vectors binary"


def k_means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centres; an empty one is put on a random row."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(rows[order], np.minimum(np.cumsum(sizes) - sizes, len(rows) - 1))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], rows[rng.integers(0, len(rows), len(centres))])
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each row's nearest centre, some rows at a time."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(part @ centres.T - half).argmax(1) for part in np.array_split(rows, max(1, len(rows) // 4096))]])


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres, and a codebook for each piece of a residual; vectors are padded to whole pieces."""

    centres: np.ndarray
    books: np.ndarray

    def padded(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, self.centres.shape[1] - rows.shape[1])))

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, length that the code leaves out, distance to the centre) of padded rows."""
        cell = nearest(rows, self.centres)
        rest = rows - self.centres[cell]
        pieces, size = len(self.books), self.books.shape[2]
        codes = np.stack([nearest(rest[:, p * size : (p + 1) * size], self.books[p]) for p in range(pieces)], 1)
        coded = np.concatenate([self.books[p][codes[:, p]] for p in range(pieces)], 1)
        return cell, codes.astype(np.uint8), np.linalg.norm(rest - coded, axis=1), np.linalg.norm(rest, axis=1)


def fit_quantiser(vectors: DataFrame, item: str, vector: str, cells: int | None = None, pieces: int = PIECES, seed: int = 5) -> Quantiser | None:
    """A quantiser of the SAMPLE vectors of least hash, and of at most SAMPLE_BYTES; by default of about sqrt(n) cells.  None if there is no vector."""
    able = vectors.where(F.col(vector).isNotNull() & F.col(item).isNotNull())
    shape = able.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("size")).first()
    if not shape.n:
        return None
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * shape["size"])))
    sample = able.select(F.xxhash64(item, F.lit(seed)).alias("h"), F.col(item).alias("i"), F.col(vector).alias("v")).orderBy("h", "i").limit(most)
    rows, rng = np.array([r.v for r in sample.collect()], np.float64), np.random.default_rng(seed)
    size = -(-rows.shape[1] // pieces)
    rows = np.pad(rows, ((0, 0), (0, size * pieces - rows.shape[1])))
    centres = k_means(rows, cells or min(MOST_CELLS, max(1, round(shape.n**0.5))), 12, rng)
    rest = rows - centres[nearest(rows, centres)]
    books = [k_means(rest[:, p * size : (p + 1) * size], CODES, 12, rng) for p in range(pieces)]
    return Quantiser(centres, np.stack(books))


def _coded(quantiser: Quantiser, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.array(batch.column("vector").to_pylist(), kind)
                cell, codes, error, far = quantiser.encode(quantiser.padded(rows.astype(np.float64)))
                raw = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (codes, rows)]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), batch.column("label"), raw[0], pa.array(error), pa.array(far), raw[1]], ["cell", "id", "label", "code", "error", "far", "raw"])

    return run


def _packed(list_rows: int):
    """Blocks of rows sorted by cell."""
    schema = pa.schema([("cell", pa.int32()), ("part", pa.int64()), ("size", pa.int32()), ("radius", pa.float64()), *[(c, pa.binary()) for c in ("ids", "labels", "codes", "errors", "vectors")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held = TaskContext.get().partitionId() << 32, []

        def block() -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            cell, ids, labels, codes, errors, fars, raws = zip(*held)
            one = {"cell": cell[0], "part": serial, "size": len(ids), "radius": max(fars), "ids": np.array(ids, "<i8").tobytes(), "labels": np.array(labels, "<i8").tobytes(), "codes": b"".join(codes), "errors": np.array(errors, "<f8").tobytes(), "vectors": b"".join(raws)}
            held.clear()
            return pa.RecordBatch.from_pylist([one], schema)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (held[0][0] != row[0] or len(held) >= list_rows):
                    yield block()
                held.append(row)
        if held:
            yield block()

    return run


@dataclass(frozen=True)
class VectorIndex:
    """The blocks that ``build_vectors`` wrote, with their quantiser and each cell's radius."""

    spark: SparkSession
    folder: str
    quantiser: Quantiser | None
    kind: str
    radius: np.ndarray

    def blocks(self, *columns: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lists").select("cell", "part", *columns)


def build_vectors(vectors: DataFrame, folder: str, item: str, vector: str, label: str | None = None, quantiser: Quantiser | None = None, list_rows: int = LIST_ROWS) -> VectorIndex:
    """Index every row with an id and a vector (null labels match no filter) in ``folder``; ids are longs and need not be unique."""
    quantiser = quantiser or fit_quantiser(vectors, item, vector)
    kind = "<f4" if "float" in dict(vectors.dtypes)[vector] else "<f8"
    tag = F.lit(-1) if label is None else F.coalesce(F.col(label), F.lit(-1))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("id"), tag.cast("long").alias("label"), F.col(vector).alias("vector"))
    if quantiser is None:
        return VectorIndex(vectors.sparkSession, folder, None, kind, np.zeros(0))
    coded = rows.mapInArrow(_coded(quantiser, kind), "cell int, id long, label long, code binary, error double, far double, raw binary")
    dealt = coded.repartitionByRange(reduce_rows(vectors.sparkSession), "cell", "id").sortWithinPartitions("cell", "id")
    dealt.mapInArrow(_packed(list_rows), _BLOCKS).write.parquet(f"{folder}/lists")
    radius = np.full(len(quantiser.centres), -1.0)  # one number a cell, of which there are at most MOST_CELLS
    for r in vectors.sparkSession.read.parquet(f"{folder}/lists").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radius[r.cell] = r.radius
    return VectorIndex(vectors.sparkSession, folder, quantiser, kind, radius)


def _probes(quantiser: Quantiser, radius: np.ndarray, probes: int):
    """Blocks of queries (query, vector, label, least), with a bit for each cell of theirs: the nearest ``probes``, or, where ``least`` is known, those that may reach it."""
    centres = quantiser.centres
    filled = np.flatnonzero(radius >= 0)

    def cells(q: np.ndarray, least: np.ndarray) -> np.ndarray:
        near_ = q @ centres[filled].T
        out = np.zeros((len(q), len(centres)), bool)
        order = np.argsort((centres[filled] ** 2).sum(1) - 2 * near_, axis=1, kind="stable")[:, :probes]
        np.put_along_axis(out, filled[order], np.isnan(least)[:, None], 1)
        out[:, filled] |= near_ + np.linalg.norm(q, axis=1)[:, None] * radius[filled] >= least[:, None] - _SLACK
        return np.packbits(out, axis=1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in (batch.slice(at, QUERIES) for at in range(0, batch.num_rows, QUERIES)):
                q = quantiser.padded(np.array(part.column("vector").to_pylist(), np.float64))
                least = np.array([np.nan if x is None else x for x in part.column("least").to_pylist()])
                label = np.array([_ANY if x is None else x for x in part.column("label").to_pylist()], "<i8")
                serial += 1
                raw = [np.asarray(part.column("query").to_numpy(), "<i8"), q, label, least, cells(q, least)]
                yield pa.RecordBatch.from_arrays([pa.array([serial]), *[pa.array([x.tobytes()], pa.binary()) for x in raw]], ["asked", "queries", "asked_vectors", "asked_labels", "least", "cells"])

    return run


def _scan(quantiser: Quantiser, kind: str, k: int, most: int, skip_self: bool):
    """The ``k`` best of each query in all the blocks that a task has: by score, then the smaller id.

    Of a block the ``most`` best by their codes get an exact score, or all whose bound reaches ``least``.
    """
    pieces, _, size = quantiser.books.shape

    def one(r: dict, ids: np.ndarray, keys: np.ndarray) -> None:
        """Put what a block of vectors has for a block of queries into (ids, keys)."""
        n = len(ids)
        bits = np.frombuffer(r["cells"], np.uint8).reshape(n, -1)
        some = np.flatnonzero(bits[:, r["cell"] // 8] >> (7 - r["cell"] % 8) & 1)
        if not len(some):
            return
        q = np.frombuffer(r["asked_vectors"]).reshape(n, -1)[some]
        label, least = np.frombuffer(r["asked_labels"], "<i8")[some, None], np.frombuffer(r["least"])[some, None]
        own = np.frombuffer(r["ids"], "<i8")
        order = np.argsort(own, kind="stable")
        own, labels, errors = own[order], np.frombuffer(r["labels"], "<i8")[order], np.frombuffer(r["errors"], "<f8")[order]
        codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, pieces)[order]
        about = q @ (quantiser.centres[r["cell"]] + np.concatenate([quantiser.books[p][codes[:, p]] for p in range(pieces)], 1)).T
        able = (label == _ANY) | (labels == label)
        if skip_self:
            able &= own != np.frombuffer(r["queries"], "<i8")[some, None]
        able &= np.isnan(least) | (about + np.linalg.norm(q, axis=1)[:, None] * errors >= least - _SLACK)
        if len(own) > most:  # where no bound is known
            about[~able] = -np.inf
            best = np.zeros(able.shape, bool)
            np.put_along_axis(best, np.argpartition(-about, most - 1, axis=1)[:, :most], True, 1)
            able &= best | ~np.isnan(least)
        vectors = quantiser.padded(np.frombuffer(r["vectors"], kind).reshape(len(own), -1).astype(np.float64)[order])
        found = np.where(able, _keys(q, vectors), _NONE)
        if len(own) > k:
            place = np.argpartition(np.arange(len(own)) - found * len(own), k - 1, axis=1)[:, :k]
            own, found = own[place], np.take_along_axis(found, place, 1)
        else:
            own = np.broadcast_to(own, found.shape)
        all_ids, all_keys = np.c_[ids[some], own], np.c_[keys[some], found]
        first = np.lexsort((all_ids, -all_keys))[:, :k]
        ids[some], keys[some] = np.take_along_axis(all_ids, first, 1), np.take_along_axis(all_keys, first, 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                (r,) = batch.slice(at, 1).to_pylist()
                if r["asked"] not in best:
                    queries = np.frombuffer(r["queries"], "<i8")
                    best[r["asked"]] = queries, np.zeros((len(queries), k), np.int64), np.full((len(queries), k), _NONE)
                one(r, *best[r["asked"]][1:])
        for queries, ids, keys in best.values():
            row, col = np.nonzero(keys > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(ids[row, col]), pa.array(keys[row, col] / 1e5)], ["query", "id", "score"])

    return run


def _pass(index: VectorIndex, queries: DataFrame, k: int, probes: int, skip_self: bool) -> DataFrame:
    """(query, id, score) that one pass over the chosen cells finds, the ``k`` best of each task.

    Blocks of queries meet blocks of vectors, not each query each block, so a
    task holds one of both and its best so far.
    """
    queries = cut_lineage(queries)
    dealt = queries.coalesce(max(1, -(-queries.count() // QUERIES)))
    asked = cut_lineage(dealt.mapInArrow(_probes(index.quantiser, index.radius, probes), "asked long, queries binary, asked_vectors binary, asked_labels binary, least binary, cells binary"))
    met = index.blocks("ids", "labels", "codes", "errors", "vectors").crossJoin(near(asked))
    return cut_lineage(met.mapInArrow(_scan(index.quantiser, index.kind, k, RERANK * k, skip_self), "query long, id long, score double"))


def search_vectors(index: VectorIndex, queries: DataFrame, query: str, vector: str, k: int = 10, label: str | None = None, exact: bool = False, skip_self: bool = False, probe_share: float = PROBE_SHARE) -> DataFrame:
    """(query, id, score, rank): the ``k`` vectors of the greatest inner product, rounded to five places; ties go to the smaller id.

    The nearest ``probe_share`` of the cells are scanned.  With ``exact``
    further cells and vectors follow as far as their bounds reach the k-th
    score found, so none is missed.  ``label`` names a column of ``queries``:
    only vectors of that label are looked at, inside the lists (null: all).
    Null queries find nothing.
    """
    spark = index.spark
    if index.quantiser is None:
        return spark.createDataFrame([], f"{query} long, id long, score double, rank int")
    tag = F.lit(None) if label is None else F.col(label)
    asked = queries.where(F.col(vector).isNotNull() & F.col(query).isNotNull()).select(F.col(query).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("vector"), tag.cast("long").alias("label"))
    probes = max(1, round(probe_share * (index.radius >= 0).sum()))
    found = _pass(index, asked.withColumn("least", F.lit(None).cast("double")), k, probes, skip_self)
    if exact:
        order = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
        least = cut_lineage(found.withColumn("r", order).where(F.col("r") == k).select("query", F.col("score").alias("least")))
        known = cut_lineage(asked.join(near(least), "query", "left").withColumn("least", F.coalesce("least", F.lit(-1e300))))
        # all cells, now by bounds; its rows stand in the place of the first pass's
        found = _pass(index, known, k, 0, skip_self)
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    best = found.withColumn("score", F.round("score", 5)).withColumn("rank", order).where(F.col("rank") <= k)
    return best.select(F.col("query").alias(query), "id", "score", "rank")
