"""Keyword search by an inverted index: delta-coded postings in blocks by document range, and top-k that skips blocks.

``build_index`` writes three tables: ``docs`` (n, id, len), ``terms`` (term,
df) and ``postings``, one row for each term and cell of CELL neighbouring
documents, with the greatest frequency and the least length in it.  Postings
are dealt by ranges of (term, document), so a frequent word is many rows in
many files, and its scan is pruned by each file's least and greatest term.

A search bounds the score of each cell from those numbers, scores the best
cells, and then only the cells whose bound reaches the k-th score found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators.tables import cut_lineage, delete_dir, near, reduce_rows

#: Documents in a cell, and cells of each query that are scored to find its first threshold.
CELL, LEAD = 512, 8
#: Parameters of Okapi BM25.
K1, B = 1.2, 0.75
_SLACK = 1e-5
_POSTINGS = "term string, cell long, size int, max_tf int, min_len int, docs binary, tfs binary, lens binary"


def pack(values: list[int]) -> bytes:
    """Numbers of 0 or more, seven bits a byte."""
    out = bytearray()
    for v in values:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def unpack(raw: bytes) -> np.ndarray:
    """The numbers that ``pack`` wrote."""
    part = np.frombuffer(raw, np.uint8)
    if not len(part):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(part < 128)
    starts = np.r_[0, ends[:-1] + 1]
    shift = np.arange(len(part)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((part & 127).astype(np.int64) << (7 * shift), starts)


def _forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, with their numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            counts = [Counter(text.split()) for text in piece.column("text").to_pylist()]
            columns = [piece.column("n"), piece.column("id"), pa.array([sum(c.values()) for c in counts], pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "id", "len", "terms", "tfs"])


def _blocks(cell_size: int):
    """Blocks of the sorted rows (term, n, tf, len): one for each run of a term and a cell."""

    def block(term: str, cell: int, rows: list[tuple[int, int, int]]) -> dict:
        ns, tfs, lens = zip(*rows)
        gaps = [ns[0] - cell * cell_size, *[b - a for a, b in zip(ns, ns[1:])]]
        return {"term": term, "cell": cell, "size": len(ns), "max_tf": max(tfs), "min_len": min(lens), "docs": pack(gaps), "tfs": pack(tfs), "lens": pack(lens)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.string()), ("cell", pa.int64()), ("size", pa.int32()), ("max_tf", pa.int32()), ("min_len", pa.int32()), *[(c, pa.binary()) for c in ("docs", "tfs", "lens")]])
        key, rows, out = None, [], []
        for batch in batches:
            for term, n, tf, size in zip(*[batch.column(c).to_pylist() for c in ("term", "n", "tf", "len")]):
                if key != (term, n // cell_size):
                    if rows:
                        out.append(block(*key, rows))
                    key, rows = (term, n // cell_size), []
                rows.append((n, tf, size))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if rows:
            out.append(block(*key, rows))
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def build_index(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> Index:
    """Write the index of the lower-case words of all texts to ``folder``.

    Every row is a document of its own, so rows of null or equal ids are found
    like any other; null texts have no words.  Documents are numbered where
    they lie, and that numbering is written before it is used.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col(doc_id).alias("id"), flat.alias("text"))
    rows.mapInArrow(_forward, f"n long, id {kind}, len int, terms array<string>, tfs array<int>").write.parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    forward.select("n", "id", "len").write.parquet(f"{folder}/docs")
    single = forward.select("n", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(F.col("t.terms").alias("term"), "n", F.col("t.tfs").alias("tf"), "len")
    sorted_ = single.repartitionByRange(reduce_rows(spark), "term", "n").sortWithinPartitions("term", "n")
    sorted_.mapInArrow(_blocks(cell), _POSTINGS).write.parquet(f"{folder}/postings")
    spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.sum("size").alias("df")).write.parquet(f"{folder}/terms")
    delete_dir(spark, f"{folder}/forward")
    return Index(spark, folder, cell)


@dataclass(frozen=True)
class Index:
    """An index that ``build_index`` wrote."""

    spark: SparkSession
    folder: str
    cell: int = CELL

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def shape(self) -> tuple[int, float]:
        """Documents with words, and their mean length."""
        row = self.read("docs").where("len > 0").agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
        return row.n, row.mean or 1.0

    def asked(self, queries: DataFrame, query: str, text: str, words: Column | None = None) -> DataFrame:
        """(query, term, df, asked): the distinct words of each query that the index has, and how many words it asks for."""
        own = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")) if words is None else words
        each = queries.select(F.col(query).alias("query"), F.size(own).alias("asked"), F.explode(own).alias("term"))
        return cut_lineage(self.read("terms").join(near(cut_lineage(each)), "term").select("query", "term", "df", "asked"))


def _tf_weight(tf, size, mean: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _scores(cell_size: int, kind: str, mean: float, k: int):
    """The best of each cell's documents, of the blocks (query, cell, term, weight, asked, docs, tfs, lens) sorted by query, cell and term."""

    def best(query, cell: int, total: np.ndarray, asked: int) -> tuple[np.ndarray, np.ndarray]:
        met = np.flatnonzero(total >= asked if kind == "all" else total > 0)
        if kind != "all" and len(met) > k:
            met = met[total[met] >= np.sort(total[met])[-k] - _SLACK]
        return met + cell * cell_size, total[met]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, asked, out, held = None, np.zeros(cell_size), 0, [], 0

        def flush() -> pa.RecordBatch:
            queries = pa.array([q for q, ns, _ in out for _ in ns], query_type)
            return pa.RecordBatch.from_arrays([queries, *[pa.array(np.concatenate([np.zeros(0, t), *[o[i] for o in out]])) for i, t in ((1, np.int64), (2, np.float64))]], ["query", "n", "score"])

        query_type = pa.int64()
        for batch in batches:
            query_type = batch.schema.field("query").type
            for query, cell, weight, n_asked, docs, tfs, lens in zip(*[batch.column(c).to_pylist() for c in ("query", "cell", "weight", "asked", "docs", "tfs", "lens")]):
                if key != (query, cell):
                    if key is not None:
                        out.append((key[0], *best(*key, total, asked)))
                        held += len(out[-1][1])
                    key, asked = (query, cell), n_asked
                    total[:] = 0
                at = np.cumsum(unpack(docs))
                total[at] += weight if kind == "all" else weight * unpack(tfs) if kind == "tf" else weight * _tf_weight(unpack(tfs), unpack(lens), mean)
            if held >= 8192:
                yield flush()
                out, held = [], 0
        if key is not None:
            out.append((key[0], *best(*key, total, asked)))
            yield flush()

    return run


def _score_cells(index: Index, known: DataFrame, cells: DataFrame, kind: str, mean: float, k: int) -> DataFrame:
    """(query, n, score) of the best documents of the listed cells (query, cell); only their blocks are read whole."""
    blocks = index.read("postings").join(near(known), "term").join(near(cells), ["query", "cell"])
    dealt = blocks.select("query", "cell", "term", "weight", "asked", "docs", "tfs", "lens").repartition(reduce_rows(index.spark), "query", "cell").sortWithinPartitions("query", "cell", "term")
    return dealt.mapInArrow(_scores(index.cell, kind, mean, k), f"query {dict(known.dtypes)['query']}, n long, score double")


def _weighted(index: Index, queries: DataFrame, query: str, text: str, kind: str) -> tuple[DataFrame, float]:
    docs, mean = index.shape()
    known = index.asked(queries, query, text)
    weight = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5)) if kind == "bm25" else F.lit(1.0)
    return known.withColumn("weight", weight).drop("df"), mean


def _plan(index: Index, queries: DataFrame, query: str, text: str, k: int, kind: str, lead: int):
    """Weighted terms, the mean length, all cells with their bounds, the documents of the lead cells, and the other cells that may hold a better one."""
    known, mean = _weighted(index, queries, query, text, kind)
    most = F.col("max_tf").cast("double") if kind == "tf" else _tf_weight(F.col("max_tf"), F.col("min_len"), mean)
    meta = index.read("postings").select("term", "cell", "max_tf", "min_len").join(near(known), "term")
    cells = cut_lineage(meta.groupBy("query", "cell").agg(F.sum(F.col("weight") * most).alias("bound"), F.count("*").alias("blocks")))
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("bound").desc(), "cell"))
    leading = cut_lineage(cells.withColumn("r", first).where(F.col("r") <= lead).select("query", "cell"))
    found = cut_lineage(_score_cells(index, known, leading, kind, mean, k))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "n"))
    least = found.withColumn("r", order).where(F.col("r") == k).select("query", F.col("score").alias("least"))
    rest = cells.join(leading, ["query", "cell"], "left_anti").join(F.broadcast(least), "query", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - _SLACK)
    return known, mean, cells, leading, found, cut_lineage(rest.select("query", "cell"))


def search(index: Index, queries: DataFrame, query: str, text: str, k: int = 10, kind: str = "bm25", lead: int = LEAD) -> DataFrame:
    """(query, id, score, rank): the ``k`` best documents of each query by BM25, or by how often its words occur (``kind`` "tf").

    Scores are rounded to five places; ties go to the smaller id.  Queries
    without a known word find nothing, and null queries have no word.
    """
    known, mean, _, _, found, rest = _plan(index, queries, query, text, k, kind, lead)
    both = found.unionByName(_score_cells(index, known, rest, kind, mean, k)).withColumn("score", F.round("score", 5))
    able = F.rank().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    few = cut_lineage(both.withColumn("r", able).where(F.col("r") <= k).drop("r"))
    named = index.read("docs").select("n", "id").join(near(few), "n")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias(query), "id", "score", "rank")


def search_report(index: Index, queries: DataFrame, query: str, text: str, k: int = 10, kind: str = "bm25", lead: int = LEAD) -> DataFrame:
    """(query, blocks, read): the blocks of each query's words, and how many of them ``search`` decodes."""
    _, _, cells, leading, _, rest = _plan(index, queries, query, text, k, kind, lead)
    used = leading.unionByName(rest).withColumn("used", F.lit(True))
    both = cells.join(used, ["query", "cell"], "left")
    return both.groupBy(F.col("query").alias(query)).agg(F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("used"), F.col("blocks")).otherwise(0)).alias("read"))


def match_all(index: Index, queries: DataFrame, query: str, words: Column) -> DataFrame:
    """(query, id) of the documents that have every one of a query's ``words`` (an array of distinct ones); an empty array matches nothing.

    Cells in which a word has no block are left out before any block is read.
    """
    known = index.asked(queries, query, "", words).drop("df").withColumn("weight", F.lit(1.0))
    able = known.groupBy("query", "asked").agg(F.count("*").alias("known")).where("known = asked").select("query")
    known = cut_lineage(known.join(able, "query", "left_semi"))
    meta = index.read("postings").select("term", "cell").distinct().join(near(known), "term")
    cells = cut_lineage(meta.groupBy("query", "cell", "asked").agg(F.count("*").alias("met")).where("met = asked").select("query", "cell"))
    found = cut_lineage(_score_cells(index, known, cells, "all", 1.0, 0))
    return index.read("docs").select("n", "id").join(near(found), "n").select(F.col("query").alias(query), "id")
