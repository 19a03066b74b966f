"""Exact search of many queries over many vectors: dealt blocks of both meet, and a task multiplies one block by another.

Queries and vectors are dealt into chunks, and each pair of chunks is a group
of its own, so neither side is held whole anywhere.  Scores are inner products
in doubles, rounded to five places half away from zero; where the order of a
sum could change a rounded place, it is summed in the order of the values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and vectors of a chunk, and scores that are held at once.
QUERIES, VECTORS, SCORES = 8192, 16384, 1 << 21
_NONE, _LAST = -(1 << 45), -(1 << 62)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, each summed from the first value on."""
    total = np.zeros(len(b))
    for d in range(b.shape[1]):
        total += a[..., d] * b[:, d]
    return total


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, with zeros for null ones, and which are null."""
    lists = column.combine_chunks()
    null = lists.is_null().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), len(values) // max(1, int((~null).sum()))))
    if out.shape[1]:
        out[~null] = values.reshape(-1, out.shape[1])
    return out, null


def _keys(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores of ``q`` with ``v`` in units of the fifth place."""
    at = q @ v.T * 1e5
    for i, j in np.argwhere(np.abs(np.abs(at) % 1 - 0.5) < 1e-6):
        at[i, j] = _in_order(q[i], v[j : j + 1])[0] * 1e5
    return (np.sign(at) * np.floor(np.abs(at) + 0.5)).astype(np.int64)


class _Blocks:
    """A chunk of queries against a chunk of vectors, some queries at a time."""

    def __init__(self, queries: pa.Table, vectors: pa.Table):
        vectors = vectors.sort_by("id")
        self.vectors, self.ids, self.labels = vectors, vectors["id"].to_numpy(), vectors["label"].combine_chunks()
        self.qids, self.queries = queries["qid"].to_numpy(), queries
        self.v, self.v_null = _matrix(vectors["vector"])
        self.q, self.q_null = _matrix(queries["asked"])
        if not self.q.shape[1] or not self.v.shape[1]:  # none that is not null
            self.q, self.v = np.zeros((len(self.q), 1)), np.zeros((len(self.v), 1))

    def parts(self) -> Iterator[slice]:
        step = max(1, SCORES // max(1, len(self.ids)))
        return (slice(at, min(at + step, len(self.qids))) for at in range(0, len(self.qids), step))

    def keys(self, part: slice) -> np.ndarray:
        """Rounded scores; those of null vectors are _NONE."""
        keys = _keys(self.q[part], self.v)
        keys[:, self.v_null] = _NONE
        keys[self.q_null[part]] = _NONE
        return keys

    def places(self, part: slice, keys: np.ndarray | None = None) -> np.ndarray:
        """One number a score that is greater for what comes first: by score, then the smaller id; a query itself is last of all."""
        n = len(self.ids)
        out = (self.keys(part) if keys is None else keys) * n + (n - 1 - np.arange(n))
        out[self.qids[part][:, None] == self.ids[None, :]] = _LAST
        return out

    def best(self, part: slice, places: np.ndarray, most: int) -> tuple:
        """(qid, id, score) of the ``most`` first of each query's ``places``."""
        best = np.argpartition(-places, most - 1, axis=1)[:, :most] if most < len(self.ids) else np.tile(np.arange(most), (len(places), 1))
        row = np.repeat(np.arange(len(places)), most)
        good = places[row, best.ravel()] > _LAST
        row, col = row[good], best.ravel()[good]
        return self.qids[part][row], self.ids[col], _score(places[row, col] // len(self.ids))


def _score(keys: np.ndarray) -> pa.Array:
    return pa.array(keys / 1e5, pa.float64(), mask=keys == _NONE)


def _met(queries: DataFrame, vectors: DataFrame, work: Callable[[_Blocks], pa.Table], schema: str, more: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """``work`` on each pair of chunks of ``queries`` (qid, vector, more) and ``vectors`` (id, label, vector, also)."""
    counts = [max(1, -(-df.count() // size)) for df, size in ((queries, QUERIES), (vectors, VECTORS))]

    def dealt(df: DataFrame, key: str, own: int) -> DataFrame:
        names, (mine, other) = ("i", "j")[:: 1 - 2 * own], (counts[own], counts[1 - own])
        return df.withColumn(names[0], F.pmod(F.xxhash64(key), F.lit(mine))).withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))

    # a column of one name and origin on both sides would be one column of the group
    left = dealt(queries.select("qid", F.col("vector").alias("asked"), *more), "qid", 0).groupBy("i", "j")
    right = dealt(vectors.select("id", "label", "vector", *also), "id", 1).groupBy("i", "j")
    kinds = [f.strip().split(" ") for f in schema.split(",")]
    arrow = pa.schema([(n, {"long": pa.int64(), "double": pa.float64()}[k]) for n, k in kinds])

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        return work(_Blocks(q, v)).cast(arrow) if q.num_rows and v.num_rows else arrow.empty_table()

    return left.cogroup(right).applyInArrow(run, schema)


def _rows(parts: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({n: pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p) for p in c]) for n, c in zip(names, zip(*parts))})


def top_scores(queries: DataFrame, vectors: DataFrame, k: int, rounded: bool = True) -> DataFrame:
    """(qid, id, score): of each pair of chunks the ``k`` best vectors of every query, itself apart; the k best of all are among them."""

    def work(b: _Blocks) -> pa.Table:
        most, parts = min(k, len(b.ids)), []
        for part in b.parts():
            if rounded:
                parts.append(b.best(part, b.places(part), most))
                continue
            about = b.q[part] @ b.v.T
            about[:, b.v_null] = -np.inf
            about[b.qids[part][:, None] == b.ids[None, :]] = -np.inf
            least = np.partition(about, len(b.ids) - most, axis=1)[:, len(b.ids) - most] - 1e-9
            for i, q in enumerate(b.q[part]):
                able = np.flatnonzero((about[i] >= least[i]) & (about[i] > -np.inf)) if not b.q_null[part][i] else np.zeros(0, np.int64)
                exact = _in_order(q, b.v[able])
                first = np.lexsort((able, -exact))[:most]
                parts.append((np.full(len(first), b.qids[part][i]), b.ids[able[first]], exact[first]))
        return _rows(parts, ["qid", "id", "score"])

    return _met(queries, vectors, work, "qid long, id long, score double")


#: Weights of a like label, the inner product, shared tags, recency and success.
WEIGHTS = (0.2, 0.4, 0.15, 0.1, 0.15)


def top_relevant(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): of each pair of chunks the ``k`` vectors of most relevance to every query (qid, qlabel, qtags, vector), itself apart.

    ``vectors`` is (id, label, vector, tags, recency, success).  Relevance is
    the sum of five terms by WEIGHTS, rounded to five places: whether the
    labels are equal, the rounded inner product, the tags in both of those in
    either (bits of a number under 256), recency and success (0 to 1).
    """
    ones = np.array([i.bit_count() for i in range(256)])

    def work(b: _Blocks) -> pa.Table:
        most, parts = min(k, len(b.ids)), []
        tags, recency, success = (b.vectors[c].to_numpy() for c in ("tags", "recency", "success"))
        kind, known = b.labels.fill_null(0).to_numpy(), b.labels.is_valid().to_numpy(zero_copy_only=False)
        asked = b.queries["qlabel"].combine_chunks()
        qkind, qknown, qtags = asked.fill_null(0).to_numpy(), asked.is_valid().to_numpy(zero_copy_only=False), b.queries["qtags"].to_numpy()
        for part in b.parts():
            keys = b.keys(part)
            like = (qkind[part][:, None] == kind) & qknown[part][:, None] & known
            either = ones[qtags[part][:, None] | tags]
            shared = ones[qtags[part][:, None] & tags] / np.maximum(either, 1)
            total = 0.0
            for weight, term in zip(WEIGHTS, (like, keys / 1e5, shared, recency, success)):
                total = total + weight * term
            total *= 1e5
            rounded = (np.sign(total) * np.floor(np.abs(total) + 0.5)).astype(np.int64)
            parts.append(b.best(part, b.places(part, np.where(keys == _NONE, _NONE, rounded)), most))
        return _rows(parts, ["qid", "id", "score"])

    return _met(queries, vectors, work, "qid long, id long, score double", ("qlabel", "qtags"), ("tags", "recency", "success"))


def pairs_above(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(qid, id, score) of all pairs of a query and another vector whose inner product is above ``least``."""

    def work(b: _Blocks) -> pa.Table:
        parts = []
        for part in b.parts():
            about = b.q[part] @ b.v.T
            about[:, b.v_null] = -np.inf
            about[b.q_null[part]] = -np.inf
            about[b.qids[part][:, None] == b.ids[None, :]] = -np.inf
            row, col = np.nonzero(about > least - 1e-9)
            for at in range(0, len(row), 1 << 16):
                r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
                exact = _in_order(b.q[part][r], b.v[c])
                good = exact > least
                exact = exact[good] * 1e5
                parts.append((b.qids[part][r[good]], b.ids[c[good]], np.sign(exact) * np.floor(np.abs(exact) + 0.5) / 1e5))
        return _rows(parts or [(b.qids[:0], b.ids[:0], np.zeros(0))], ["qid", "id", "score"])

    return _met(queries, vectors, work, "qid long, id long, score double")


def best_ranks(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, label, r): the rank that the first vector of each label has among all but the query itself, by score and then the smaller id.

    A first pass finds the best vector of each label, a second counts what is before it.
    """

    def best(b: _Blocks) -> pa.Table:
        kinds = b.labels.dictionary_encode(null_encoding="encode")
        code, parts = kinds.indices.to_numpy(), []
        groups = [np.flatnonzero(code == c) for c in range(len(kinds.dictionary))]
        for part in b.parts():
            places = b.places(part)
            for c, own in enumerate(groups):
                top = own[places[:, own].argmax(1)]
                value = places[np.arange(len(places)), top]
                good = value > _LAST
                parts.append((b.qids[part][good], pa.array([kinds.dictionary[c].as_py()] * int(good.sum()), pa.int64()), value[good] // len(b.ids), b.ids[top[good]]))
        return _rows(parts, ["qid", "label", "key", "id"])

    firsts = _met(queries, vectors, best, "qid long, label long, key long, id long")
    first = firsts.groupBy("qid", "label").agg(F.max(F.struct("key", (-F.col("id")).alias("minus"))).alias("b"))
    wanted = first.groupBy("qid").agg(F.collect_list(F.struct("label", F.col("b.key").alias("key"), (-F.col("b.minus")).alias("id"))).alias("w"))
    asked = queries.select("qid", "vector").join(wanted, "qid").select("qid", "vector", F.transform("w", lambda x: x["label"]).alias("wl"), F.transform("w", lambda x: x["key"]).alias("wk"), F.transform("w", lambda x: x["id"]).alias("wi"))

    def ahead(b: _Blocks) -> pa.Table:
        n, parts = len(b.ids), []
        labels, keys, ids = (b.queries[c].combine_chunks() for c in ("wl", "wk", "wi"))
        for part in b.parts():
            places = np.sort(b.places(part), axis=1)
            for i, at in enumerate(range(part.start, part.stop)):
                mark = keys[at].values.to_numpy() * n + n - 1 - np.searchsorted(b.ids, ids[at].values.to_numpy())
                parts.append((np.full(len(mark), b.qids[at]), labels[at].values, n - np.searchsorted(places[i], mark, "right")))
        return _rows(parts, ["qid", "label", "before"])

    counted = _met(asked, vectors, ahead, "qid long, label long, before long", ("wl", "wk", "wi"))
    return counted.groupBy("qid", "label").agg((F.sum("before") + 1).alias("r"))
