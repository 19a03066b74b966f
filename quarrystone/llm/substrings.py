"""Removal of long repeated word passages, found by difference-cover anchors.

Passages of ``WINDOW`` = 13 words matter.  Hashing all 13-word windows of a
corpus would move one row a word.  Instead 7-word anchors are hashed only at
word positions that are 1, 2 or 4 modulo 7.  {1, 2, 4} is a perfect difference
cover: for any two positions i and j some shift d < 7 brings both i + d and
j + d onto the cover, so two equal 13-word windows, wherever they stand, share
an anchor that lies inside both (7 + 7 - 1 = 13).

1. Anchors that occur in two documents are found; every window around one is
   a candidate.
2. Candidates are extended to their 13 words and hashed whole; a window is
   repeated if a document of smaller id has the same one.
3. Words of repeated windows are left out.

Both hash steps send a row only for what a batch cannot settle itself: of a
passage that many documents of one batch share, one document's rows go on.  So
a passage in a third of all documents gives as many rows as there are batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, raw_texts
from quarrystone.operators.tables import reduce_rows

WINDOW, ANCHOR, PERIOD, COVER = 13, 7, 7, (1, 2, 4)
_MULTIPLIER = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1
#: Blobs that one batch's rows are dealt into, for each reducing task.
_SPREAD = 4


def word_hashes(parts: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(w, 91) for w in parts], np.uint64, len(parts))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words."""
    n = len(words) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    factor = 1
    for i in range(length if n > 0 else 0):
        out += words[i : i + n] * np.uint64(factor)
        factor = factor * _MULTIPLIER & 0xFFFFFFFFFFFFFFFF
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def cover_positions(n_words: int) -> np.ndarray:
    """Anchor positions of a text, in order."""
    at = np.arange(max(0, n_words - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)]


def _runs(key: np.ndarray) -> np.ndarray:
    """For sorted keys: the number of each element's group."""
    return np.cumsum(np.r_[0, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def merge_ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges, in order, without overlap."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > stop[:-1]]
    return start[new], stop[np.r_[np.flatnonzero(new)[1:] - 1, len(stop) - 1]]


def pack_rows(key: np.ndarray, columns: list[np.ndarray], width: int) -> bytes:
    """Keys (their low ``width`` bytes) and integer columns (as differences), compressed."""
    kept = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    steps = b"".join(np.diff(c, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(key).to_bytes(4, "little") + kept + zstandard.ZstdCompressor(level=1).compress(steps)


def unpack_rows(raw: bytes, columns: int, width: int) -> list[np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    key = np.zeros((n, 8), np.uint8)
    key[:, :width] = np.frombuffer(raw, np.uint8, n * width, 4).reshape(n, width)
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4 + n * width :], max_output_size=8 * n * columns), np.uint8).reshape(columns, 8, n)
    return [key.view(np.uint64).ravel(), *(np.cumsum(np.ascontiguousarray(c.T).view("<i8").ravel()) for c in steps)]


def _blobs(key: np.ndarray, columns: list[np.ndarray], parts: int, width: int) -> Iterator[pa.RecordBatch]:
    """One row for each part that the keys fall into."""
    part = ((key * np.uint64(_MULTIPLIER)) >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    names = np.flatnonzero(np.diff(ends))
    for at in range(0, len(names), 256):
        own = names[at : at + 256]
        raw = [pack_rows(key[x], [c[x] for c in columns], width) for x in (order[ends[i] : ends[i + 1]] for i in own)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), bool)), pa.array(raw, pa.binary())], ["part", "settled", "blob"])


def _settled(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """What is known to hold already, as ranges of each document."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    names, lows, highs = [], [], []
    for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
        low, high = merge_ranges(start[part], stop[part])
        names.append(np.full(len(low), doc[part[0]])), lows.append(low), highs.append(high)
    columns = [np.concatenate(names), np.concatenate(lows), np.concatenate(highs)]
    raw = pack_rows(np.zeros(len(columns[0]), np.uint64), columns, 0)
    yield pa.RecordBatch.from_arrays([pa.array([int(doc[0]) % parts]), pa.array([True]), pa.array([raw], pa.binary())], ["part", "settled", "blob"])


_BLOBS = "part long, settled boolean, blob binary"
_ANCHOR_BYTES, _WINDOW_BYTES = 6, 8  # a chance match of anchors only gives a candidate more; windows decide


def _orders(piece: pa.RecordBatch) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in piece.column("id").to_pylist()], np.int64)


def _anchor_rows(parts: int):
    """Anchors of each text; a range is that of the candidate window starts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 8192, 12 << 20):
            docs, hashes, spots, lengths = piece.column("doc").to_numpy(), [], [], []
            for raw in raw_texts(piece.column("text")):
                words = raw.split()
                at = cover_positions(len(words)) if len(words) >= WINDOW else np.zeros(0, np.int64)
                hashes.append(run_hashes(word_hashes(words), ANCHOR)[at] if len(at) else np.zeros(0, np.uint64))
                spots.append(at)
                lengths.append(len(words))
            counts = [len(x) for x in spots]
            key, at, doc, n = np.concatenate(hashes), np.concatenate(spots), np.repeat(docs, counts), np.repeat(lengths, counts)
            start, stop = np.maximum(0, at - (WINDOW - ANCHOR)), np.minimum(at, n - WINDOW) + 1
            order = np.lexsort((doc, key))
            sorted_key, sorted_doc = key[order], doc[order]
            group = _runs(sorted_key)
            first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
            many = np.zeros(group[-1] + 1 if len(group) else 0, bool)
            if len(group):
                many[group[1:][~first[1:] & (sorted_doc[1:] != sorted_doc[:-1])]] = True
            shared = np.zeros(len(key), bool)
            shared[order] = many[group]
            send = ~shared
            send[order[first]] = True
            # of an anchor that two documents of the piece share, one row goes on, so that others learn of it
            send = np.flatnonzero(send)
            yield from _blobs(key[send], [doc[send], start[send], stop[send], shared[send].astype(np.int64)], parts, _ANCHOR_BYTES)
            yield from _settled(doc[shared], start[shared], stop[shared], parts)

    return run


def _out(doc, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(stop)], ["doc", "start", "stop"])


_OUT = "doc long, start long, stop long"


def _by_part(batches: Iterable[pa.RecordBatch], columns: int, width: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(settled, columns) of each part's rows, from blobs in order of part."""
    name, held = None, []
    for batch in batches:
        for part, settled, raw in zip(batch.column("part").to_pylist(), batch.column("settled").to_pylist(), batch.column("blob").to_pylist()):
            if settled:
                yield True, unpack_rows(raw, 3, 0)
                continue
            if part != name and held:
                yield False, [np.concatenate(x) for x in zip(*held)]
                held = []
            name = part
            held.append(unpack_rows(raw, columns, width))
    if held:
        yield False, [np.concatenate(x) for x in zip(*held)]


def _shared_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges around the anchors that two documents have."""
    for settled, rows in _by_part(batches, 4, _ANCHOR_BYTES):
        if settled:
            yield _out(*rows[1:])
            continue
        order = np.lexsort((rows[1], rows[0]))
        key, doc, start, stop, shared = (x[order] for x in rows)
        group = _runs(key)
        hit = np.zeros(group[-1] + 1, bool)
        hit[group[1:][(group[1:] == group[:-1]) & (doc[1:] != doc[:-1])]] = True
        hit[group[shared > 0]] = True
        keep = hit[group] & (shared == 0)
        yield _out(doc[keep], start[keep], stop[keep])


def _window_rows(parts: int):
    """Hashes of the candidate windows of each text; a range is that of a window's words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 8192, 12 << 20):
            docs, orders = piece.column("doc").to_numpy(), _orders(piece)
            rows, keys, spots = [], [], []
            lows, highs = piece.column("lows").to_pylist(), piece.column("highs").to_pylist()
            for row, raw in enumerate(raw_texts(piece.column("text"))):
                if not lows[row]:
                    continue
                hashes = run_hashes(word_hashes(raw.split()), WINDOW)
                at = np.concatenate([np.arange(a, b) for a, b in zip(lows[row], highs[row])])
                rows.append(np.full(len(at), row)), keys.append(hashes[at]), spots.append(at)
            if not rows:
                continue
            row, key, at = np.concatenate(rows), np.concatenate(keys), np.concatenate(spots)
            doc, order = docs[row], orders[row]
            sort = np.lexsort((order, key))
            group = _runs(key[sort])
            least = np.zeros(len(key), np.int64)
            least[sort] = order[sort][np.r_[True, group[1:] != group[:-1]]][group] if len(key) else 0
            later = order > least
            send = ~later
            yield from _blobs(key[send], [doc[send], order[send], at[send]], parts, _WINDOW_BYTES)
            yield from _settled(doc[later], at[later], at[later] + WINDOW, parts)

    return run


def _repeated_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that a document of smaller id has too."""
    for settled, rows in _by_part(batches, 3, _WINDOW_BYTES):
        if settled:
            yield _out(*rows[1:])
            continue
        sort = np.lexsort((rows[2], rows[0]))
        key, doc, order, at = (x[sort] for x in rows)
        group = _runs(key)
        later = order > order[np.r_[True, group[1:] != group[:-1]]][group]
        yield _out(doc[later], at[later], at[later] + WINDOW)


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ranges in order of doc: one row a document."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def rows(doc, start, stop) -> pa.RecordBatch:
        names, lows, highs = [], [], []
        for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []:
            low, high = merge_ranges(start[part], stop[part])
            names.append(doc[part[0]]), lows.append(low), highs.append(high)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))], ["doc", "lows", "highs"])

    for batch in batches:
        held = [np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(held)]
        if len(held[0]):
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield rows(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    yield rows(*held)


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        lows, highs = piece.column("lows").to_pylist(), piece.column("highs").to_pylist()
        n, removed, digests, texts = [], [], [], []
        for row, raw in enumerate(raw_texts(piece.column("text"))):
            parts = raw.split()
            n.append(len(parts))
            kept, at = [], 0
            for low, high in zip(lows[row] or (), highs[row] or ()):
                kept += parts[at:low]
                at = high
            kept += parts[at:]
            removed.append(len(parts) - len(kept))
            text = b" ".join(kept)
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode("utf-8"))
        yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) of every row.

    Each word of a 13-word window that also starts in a row of smaller id is
    left out; windows are judged on the input.  Null texts have no words.
    Rows of equal id are not smaller than each other, so the same window stays
    in both; a null id counts as larger than all.  Texts of fewer than 13
    words stay whole.  Other columns are not read.
    """
    n = reduce_rows(docs.sparkSession)
    able = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    plain = able.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty()
    # rows are known by their id where that tells them apart; equal rows may share a name, as all that holds of one holds of the other
    name = F.col("id") if plain else F.xxhash64("id", "text")
    # one exchange of the texts serves all three readings, as all read the same columns
    rows = able.select("id", name.alias("doc"), "text").repartition(n, "doc")

    def ranged(found: DataFrame, judge) -> DataFrame:
        dealt = found.repartition(n, "part").sortWithinPartitions("part").mapInArrow(judge, _OUT)
        return dealt.repartition(n, "doc").sortWithinPartitions("doc").mapInArrow(_merged, "doc long, lows array<long>, highs array<long>")

    candidates = ranged(rows.mapInArrow(_anchor_rows(_SPREAD * n), _BLOBS), _shared_anchors)
    near = rows.join(candidates.hint("shuffle_hash"), "doc", "left")
    covered = ranged(near.mapInArrow(_window_rows(_SPREAD * n), _BLOBS), _repeated_windows)
    out = rows.join(covered.hint("shuffle_hash"), "doc", "left")
    return out.mapInArrow(_kept, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("id", doc_id)
