"""Patched frame-of-reference files of token ids.

A shard is a sequence of blocks, a document index and a block index:

    block     count u16, exceptions u16, width u8, minimum u32,
              ceil(count * width / 8) bytes of packed (id - minimum),
              exception positions u16 each, exception values (id - minimum) u32 each
    documents doc_id i64 each, null mark u8 each, end (ids up to and with the document) u64 each
    blocks    byte offset of each block u64
    footer    documents u64, ids u64, blocks u64, offset of the document index u64,
              offset of the block index u64, block size u32, magic "QPFOR001"

All numbers are little-endian.  A block's width is that of the value at a
chosen percentile of its (id - minimum); larger values are exceptions, stored
whole, with zero in their packed place.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyarrow import fs

MAGIC = b"QPFOR001"
BLOCK, PERCENTILE = 1024, 0.95
_HEAD, _FOOT = "<HHBI", "<QQQQQI8s"
_HEAD_SIZE, _FOOT_SIZE = struct.calcsize(_HEAD), struct.calcsize(_FOOT)


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of 1 to 65535 ids (uint32)."""
    low = int(ids.min())
    rest = ids - np.uint32(low)
    at = max(0, math.ceil(percentile * len(rest)) - 1)
    width = int(np.partition(rest, at)[at]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    large = rest[over]
    rest[over] = 0
    if width in (8, 16):
        packed = rest.astype(f"<u{width // 8}").tobytes()
    else:
        packed = np.packbits((rest[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1, bitorder="little").tobytes()
    return struct.pack(_HEAD, len(ids), len(over), width, low) + packed + over.astype("<u2").tobytes() + large.astype("<u4").tobytes()


def unpack_block(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at ``at``, and where the next one begins."""
    count, over, width, low = struct.unpack_from(_HEAD, raw, at)
    at += _HEAD_SIZE
    size = (count * width + 7) // 8
    if width in (8, 16):
        out = np.frombuffer(raw, f"<u{width // 8}", count, at).astype(np.uint32)
    elif width:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=count * width, bitorder="little").reshape(count, width)
        out = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    else:
        out = np.zeros(count, np.uint32)
    at += size
    if over:
        spots = np.frombuffer(raw, "<u2", over, at)
        out[spots] = np.frombuffer(raw, "<u4", over, at + 2 * over)
    return out + np.uint32(low), at + 6 * over


def write_shard(uri: str, docs: Iterable[tuple[int | None, np.ndarray]], block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[int, int]:
    """Write (doc_id, ids as u32) in the given order; returns documents and ids.

    Only one block's ids and the document index are held.
    """
    store, path = fs.FileSystem.from_uri(uri)
    names, nulls, ends, offsets = [], [], [], []
    total = at = 0
    waiting, held = [], 0
    with store.open_output_stream(path) as out:

        def put(final: bool) -> None:
            nonlocal waiting, held, at
            ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
            stop = len(ids) if final else len(ids) - len(ids) % block
            for start in range(0, stop, block):
                raw = pack_block(ids[start : start + block].copy(), percentile)
                offsets.append(at)
                at += out.write(raw)
            waiting, held = [ids[stop:]], len(ids) - stop

        for name, ids in docs:
            total += len(ids)
            names.append(name or 0), nulls.append(name is None), ends.append(total)
            waiting.append(ids)
            held += len(ids)
            if held >= 64 * block:
                put(False)
        put(True)
        index = at
        for column, kind in ((names, "<i8"), (nulls, "<u1"), (ends, "<u8"), (offsets, "<u8")):
            raw = np.asarray(column, dtype=kind).tobytes()
            at += out.write(raw)
        out.write(struct.pack(_FOOT, len(names), total, len(offsets), index, at - 8 * len(offsets), block, MAGIC))
    return len(names), total


class Shard:
    """A shard opened for reading."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.docs, self.ids, self.blocks, index, self.end, self.block, magic = struct.unpack(_FOOT, self._at(size - _FOOT_SIZE, _FOOT_SIZE))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        raw = self._at(index, self.docs * 17)
        self.names = np.frombuffer(raw, "<i8", self.docs)
        self.nulls = np.frombuffer(raw, "<u1", self.docs, 8 * self.docs).astype(bool)
        self.ends = np.frombuffer(raw, "<u8", self.docs, 9 * self.docs).astype(np.int64)
        self.offsets = np.r_[np.frombuffer(self._at(self.end, self.blocks * 8), "<u8").astype(np.int64), index]

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        raw, at, parts = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first])), 0, []
        while at < len(raw):
            ids, at = unpack_block(raw, at)
            parts.append(ids)
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def digests(self, most_ids: int = 1 << 18) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in the shard, ids, crc32 of the little-endian ids) of each document."""
        low, held = 0, np.zeros(0, np.uint32)
        start = 0
        for row in range(self.docs):
            stop, crc, at = int(self.ends[row]), 0, start
            while at < stop:
                if at >= low + len(held):
                    low = at - at % self.block
                    held = self.read(low, min(self.ids, low + most_ids))
                upto = min(stop, low + len(held))
                crc = zlib.crc32(held[at - low : upto - low].astype("<u4").tobytes(), crc)
                at = upto
            yield (None if self.nulls[row] else int(self.names[row])), start, stop - start, crc
            start = stop
