"""Toxicity by a factorization machine over hashed terms.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)

The pair weights <v_i, v_j> let two terms count together, such as an insult
beside a group's name, which a sum of single weights misses.  Terms are the
distinct lower-case words, hashed to ``2 ** BITS`` slots and weighted by
inverse document frequency.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, raw_texts
from quarrystone.operators.tables import cut_lineage

BITS = 20
#: Bounds of the labelled sample: documents of either label that the driver ever holds (as term slots, all of each).
MOST_TOXIC, MOST_CLEAN = 5000, 10000
#: Bounds of their term slots (4 bytes each): of one document, and of all of either label.  Documents beyond are not learned from.
MOST_DOC_SLOTS, MOST_SLOTS = 200_000, 16_000_000
THRESHOLD = 0.3
#: Of a pair's terms; above that of single terms, as there are many more pairs than terms to meet it by chance.
LEAST_PAIR_CHI2 = 32.0
_WORD = re.compile(r"\w+")
_CACHE = 60_000


@dataclass
class Machine:
    """Weights of the kept slots. ``place[slot]`` is 0 for all others, whose weights are zero."""

    place: np.ndarray
    idf: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def term_slots(raw: bytes, cache: dict[str, int], bits: int = BITS) -> np.ndarray:
    """Distinct hashed slots of a text's words."""
    found = set(_WORD.findall(raw.decode("utf-8", "replace").lower()))
    if len(cache) > _CACHE:
        cache.clear()
    for w in found.difference(cache):
        cache[w] = zlib.crc32(w.encode()) & ((1 << bits) - 1)
    return np.unique(np.fromiter(map(cache.__getitem__, found), np.int64, len(found)))


def _slot_rows(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for piece in pieces(batches, "text"):
            slots = [term_slots(raw, cache, bits).astype("<i4").tobytes() for raw in raw_texts(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("label"), pa.array(slots, pa.binary())], ["label", "slots"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, learn_from: str, doc_id: str, text: str, label: str, bits: int, seed: int) -> list:
    """Rows (label, slots) of at most MOST_TOXIC and MOST_CLEAN documents, of least seeded hash.

    A label holds for an id; an id labelled both ways counts as 1.  Of several
    texts of an id the one of least hash is learned from, so reruns learn the
    same.  Documents are learned from whole or not at all: not if they have
    over MOST_DOC_SLOTS different terms, nor past MOST_SLOTS of a label.  Null ids and labels other than 0 and 1 teach nothing.
    """
    able = labels.where(F.expr(learn_from) & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    able = able.groupBy(F.col(doc_id).alias("i")).agg(F.max(F.col(label).cast("int")).alias("label"))
    able = able.join(docs.select(F.col(doc_id).alias("i")).distinct(), "i", "left_semi").withColumn("h", F.xxhash64("i", F.lit(seed)))
    chosen = able.where("label = 1").orderBy("h", "i").limit(MOST_TOXIC).unionAll(able.where("label = 0").orderBy("h", "i").limit(MOST_CLEAN))
    # at most MOST_TOXIC + MOST_CLEAN ids, so the broadcast is bounded
    picked = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).join(F.broadcast(chosen.select("i", "label")), "i")
    one = picked.groupBy("i", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).withColumn("h", F.xxhash64("i", F.lit(seed)))
    made = one.select(F.struct("h", "i", "label").alias("label"), "text").mapInArrow(_slot_rows(bits), f"label struct<h: bigint, i: {dict(one.dtypes)['i']}, label: int>, slots binary")
    rows = cut_lineage(made.select("label.*", "slots"))
    # whole documents of least hash until either label's share of slots is full; the window runs over one number a sampled document
    sizes = rows.select("h", "i", "label", (F.octet_length("slots") / 4).cast("long").alias("n")).where(F.col("n") <= MOST_DOC_SLOTS)
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("h", "i").rowsBetween(Window.unboundedPreceding, 0))
    fits = sizes.withColumn("upto", upto).where(F.col("upto") <= MOST_SLOTS).select("i")
    found = sorted((r.label, bytes(r.slots)) for r in rows.join(F.broadcast(fits), "i", "left_semi").select("label", "slots").collect())
    return [(label, np.frombuffer(slots, "<i4")) for label, slots in found]


def pair_terms(docs: list[np.ndarray], y: np.ndarray, terms: int, least_chi2: float) -> np.ndarray:
    """Terms of pairs that count together: among the documents of either term, the other's presence goes with the label by ``least_chi2``.

    ``docs`` has the distinct terms of each document, from 0 to ``terms`` - 1.
    A term of fewer documents than ``least_chi2`` cannot reach it.  Costs the
    squares of the documents' numbers of terms, one term's neighbours at a time.
    """
    lengths = np.array([len(d) for d in docs], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64)
    flat = np.concatenate(docs)
    ends = np.cumsum(np.bincount(flat, minlength=terms))
    by_term = np.argsort(flat, kind="stable").astype(np.int32)
    del flat
    by_term = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)[by_term]
    found = []
    for a in range(terms):
        own = by_term[(ends[a - 1] if a else 0) : ends[a]]
        n, n_1 = len(own), y[own].sum()
        if n < least_chi2 or not 0 < n_1 < n:
            continue
        both = np.bincount(np.concatenate([docs[i] for i in own]), minlength=terms).astype(np.float64)
        ones = np.bincount(np.concatenate([docs[i] for i in own if y[i]]), minlength=terms)
        spread = both * (n - both) * n_1 * (n - n_1)
        near = np.flatnonzero(n * (ones * n - both * n_1) ** 2 >= least_chi2 * np.where(spread > 0, spread, np.inf))
        found.append(a * terms + near)
    pairs = np.concatenate([np.zeros(0, np.int64), *found])
    mutual = np.intersect1d(pairs, pairs % terms * terms + pairs // terms)
    return np.unique(mutual // terms)


def fit(rows: list, bits: int = BITS, factors: int = 6, rounds: int = 60, rate: float = 0.2, decay: float = 1e-6, least_docs: int = 4, least_chi2: float = 16.0, least_pair_chi2: float = LEAST_PAIR_CHI2, prior: float = 0.2, seed: int = 11) -> Machine:
    """Train on (label, slots) rows by AdaGrad on the logistic loss; label 1 weighs ``prior`` of the whole.

    Slots in fewer than ``least_docs`` rows, or whose presence goes with the
    label by less than ``least_chi2``, are left out, so that rare words of
    single documents are not learned by heart; but terms of pairs that go with
    the label together (``pair_terms``) stay.  Without rows of both labels
    the machine answers that label (0 if no rows).
    """
    size = 1 << bits
    y = np.array([r[0] for r in rows], np.float64)
    count = lambda own: np.bincount(np.concatenate([np.zeros(0, np.int32), *own]), minlength=size)
    counts, ones = count([r[1] for r in rows]), count([r[1] for r in rows if r[0]])
    n, n_1 = max(1, len(rows)), y.sum()
    some = np.flatnonzero(counts >= least_docs)
    spread = counts[some] * (n - counts[some]) * n_1 * (n - n_1)
    chi2 = np.where(spread > 0, n * (ones[some] * n - counts[some] * n_1) ** 2 / np.maximum(spread, 1), 0)
    alone, able = np.zeros(size, bool), some[counts[some] >= least_pair_chi2]
    alone[some] = chi2 >= least_chi2
    place = np.zeros(size, np.int32)
    if not alone[able].all():
        place[able] = np.arange(1, len(able) + 1)
        alone[able[pair_terms([(p := place[r[1]])[p > 0] - 1 for r in rows], y, len(able), least_pair_chi2)]] = True
        place[:] = 0
    kept = np.flatnonzero(alone)
    place[kept] = np.arange(1, len(kept) + 1)
    idf = np.r_[0.0, np.log((len(rows) + 1) / (counts[kept] + 1)) / np.log(len(rows) + 2)]
    linear, pair = np.zeros(len(kept) + 1), np.random.default_rng(seed).normal(0, 0.05, (len(kept) + 1, factors))
    pair[0] = 0
    rate_1 = y.mean() if len(y) else 0.0
    if not 0 < rate_1 < 1:
        return Machine(place, idf, 20.0 if rate_1 else -20.0, linear, pair * 0)
    bias = -1.0
    g_bias, g_linear, g_pair = 1e-6, np.full_like(linear, 1e-6), np.full_like(pair, 1e-6)
    rng = np.random.default_rng(seed)
    docs = [(p := place[r[1]])[p > 0] for r in rows]
    docs = [d if len(d) else np.zeros(1, np.int32) for d in docs]
    weight = 2 * np.where(y > 0, prior / rate_1, (1 - prior) / (1 - rate_1))
    for _ in range(rounds):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            own = [docs[i] for i in part]
            lengths = np.array([len(d) for d in own])
            start = np.r_[0, np.cumsum(lengths)[:-1]]
            index = np.concatenate(own)
            x = idf[index]
            vx = pair[index] * x[:, None]
            sums = np.add.reduceat(vx, start, axis=0)
            raw = bias + np.add.reduceat(linear[index] * x, start) + 0.5 * (sums**2 - np.add.reduceat(vx**2, start, axis=0)).sum(1)
            slope = weight[part] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            s = np.repeat(slope, lengths) * x
            used, spot = np.unique(index, return_inverse=True)
            d_linear = np.bincount(spot, s) + decay * linear[used]
            d_pair = np.stack([np.bincount(spot, s * (np.repeat(sums[:, f], lengths) - vx[:, f])) for f in range(factors)], 1) + decay * pair[used]
            d_bias = slope.sum()
            g_bias += d_bias**2
            g_linear[used] += d_linear**2
            g_pair[used] += d_pair**2
            bias -= rate * d_bias / np.sqrt(g_bias)
            linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            pair[used] -= rate * 0.3 * d_pair / np.sqrt(g_pair[used])
    return Machine(place, idf, float(bias), linear, pair)


def score_slots(model: Machine, docs: list[np.ndarray]) -> np.ndarray:
    """Probability of label 1 for each document's slots."""
    raw = np.full(len(docs), model.bias)
    lengths = np.array([len(d) for d in docs], np.int64)
    index = model.place[np.concatenate(docs)] if lengths.sum() else np.zeros(0, np.int64)
    known = np.flatnonzero(index)
    if len(known):
        row = np.repeat(np.arange(len(docs)), lengths)[known]
        index = index[known]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        x = model.idf[index]
        vx = model.factors[index] * x[:, None]
        pairs = np.add.reduceat(vx, start, axis=0) ** 2 - np.add.reduceat(vx**2, start, axis=0)
        raw[row[start]] += np.add.reduceat(model.linear[index] * x, start) + 0.5 * pairs.sum(1)
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _score(shared, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for piece in pieces(batches, "text"):
            scores = score_slots(model, [term_slots(raw, cache, bits) for raw in raw_texts(piece.column("text"))])
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(scores)], ["id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn_from: str = "true", doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bits: int = BITS, seed: int = 5) -> Machine:
    """A machine fitted to a bounded sample of the labelled documents where ``learn_from`` holds."""
    return fit(labelled_sample(docs, labels, learn_from, doc_id, text, label, bits, seed), bits)


def score_texts(docs: DataFrame, model: Machine, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every row.

    Null and empty texts get the machine's bias alone.  Rows of null or
    repeated id are scored like any other.  Only the two named columns are
    read.  The model, at most ``2 ** bits`` slots of 9 numbers, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_score(shared, bits), "id long, score double")
    return rows.select(F.col("id").alias(doc_id), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Machine, text: str = "text", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns; the text is scored where it lies, without a join.

    A null or empty text scores the machine's bias; repeated rows and null
    ids are judged like any other, so equal texts go or stay together.  An
    empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for piece in pieces(batches, text):
            scores = score_slots(shared.value, [term_slots(raw, cache, bits) for raw in raw_texts(piece.column(text))])
            yield piece.filter(pa.array(scores < threshold))

    return docs.mapInArrow(keep, docs.schema)
