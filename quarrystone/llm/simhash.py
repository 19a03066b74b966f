"""SimHash near-duplicate groups by anchor-point covering.

Two 64-bit fingerprints at most 3 bits apart differ in at most one bit in one
of their 32-bit halves.  Each half is covered by a code: the perfect Hamming
[31, 26] code on 31 bits, times the whole space on the last bit.  Its
codewords are the *anchors*; its covering radius is 1, so every half lies
within 1 of its home anchor, and a half that differs in at most one bit lies
within 2 of it.  A fingerprint is therefore replicated to every anchor within
covering radius plus threshold, 1 + 1 = 2, of either half: at most 17 anchors
a half.  Fingerprints are compared only with those at the same anchor, by the
full 64-bit distance.  A pair is found if either is at home there, so pairs of
two visitors need no look.

Exact copies collapse to one fingerprint before anything is replicated.  A
group at an anchor above ``group_rows`` is dealt out in chunk pairs, so that
no task holds more than two chunks, whatever the size of the group.  Within a
task, links are followed to a forest, and only its edges are emitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, raw_texts
from quarrystone.operators.components import connected_components
from quarrystone.operators.tables import by_keys, cut_lineage, free_names, join_hot, near, reduce_rows

#: Rows at one anchor that one task compares at once.
GROUP_ROWS = 4096
_CHUNK = 1 << 17
_BELOW = (1 << 31) - 1


def fingerprints(texts: list[bytes], shingle_words: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 SimHash of each text: ASCII letters lowered, words split at ASCII white space.

    A bit is set if it is set in over half of the shingles' XXH64; shingles
    count as often as they occur.  A text of fewer words is one shingle; one
    of no words has fingerprint zero.
    """
    digest, k = xxhash.xxh64_intdigest, shingle_words
    ones = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    starts: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
            np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            hashes.clear(), starts.clear(), owners.clear()

    for row, raw in enumerate(texts):
        parts = raw.lower().split()
        n = len(parts)
        if not n:
            continue
        joined = b" ".join(parts)
        if n <= k:
            lows, highs = [0], [len(joined)]
        else:
            lengths = np.fromiter(map(len, parts), np.int64, n)
            ends = np.cumsum(lengths + 1) - 1
            lows, highs = (ends - lengths)[: n - k + 1].tolist(), ends[k - 1 :].tolist()
        totals[row] = len(lows)
        for at in range(0, len(lows), _CHUNK):
            starts.append(len(hashes))
            owners.append(row)
            hashes += [digest(joined[a:b], seed) for a, b in zip(lows[at : at + _CHUNK], highs[at : at + _CHUNK])]
            if len(hashes) >= _CHUNK:
                flush()
    flush()
    return np.packbits(ones * 2 > totals[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def anchor_rows(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the print, anchor, at home) for all anchors within 2 of either half."""
    rows, keys, homes = [], [], []
    place = np.arange(len(prints))
    for side, half in enumerate(((prints >> np.uint64(32)).astype(np.int64), (prints & np.uint64(0xFFFFFFFF)).astype(np.int64))):
        word, last = half & _BELOW, half >> 31
        syndrome = np.zeros(len(prints), np.int64)
        for bit in range(31):
            syndrome ^= ((word >> bit) & 1) * (bit + 1)

        def put(which: np.ndarray, code: np.ndarray, bit: np.ndarray, home: bool) -> None:
            rows.append(place[which])
            keys.append((side << 32) | (bit[which] << 31) | code[which])
            homes.append(np.full(len(rows[-1]), home))

        everyone = np.ones(len(prints), bool)
        nearest = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
        put(everyone, nearest, last, True)
        put(everyone, nearest, 1 - last, False)
        for i in range(1, 32):
            j = i ^ syndrome
            put((syndrome > 0) & (j > i), word ^ (1 << (i - 1)) ^ (1 << np.maximum(j - 1, 0)), last, False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def link_forest(prints: np.ndarray, homes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links with an end at home.

    Every print that is at home is compared with all that no tree holds yet,
    and with the trees' other members at home only as they are reached, so a
    tight group costs about one comparison a member.
    """
    edges = []
    left = np.ones(len(prints), bool)
    for root in np.flatnonzero(homes):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left if homes[at] else left & homes)
            near = rest[np.bitwise_count(prints[rest] ^ prints[at]) <= max_bits]
            left[near] = False
            edges += [(at, x) for x in near]
            queue += near.tolist()
    return edges


def _compare(max_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64), np.zeros(0, bool)]
        for batch in _then_none(batches):
            if batch is None:
                ready, tail = tail, None
            else:
                got = [batch.column("anchor").to_numpy(), batch.column("part").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)]
                full = [np.concatenate(x) for x in zip(tail, got)]
                if not len(full[0]):
                    continue
                other = np.flatnonzero((full[0] != full[0][-1]) | (full[1] != full[1][-1]))
                last = int(other[-1]) + 1 if len(other) else 0  # the last run may go on in the next batch
                ready, tail = [x[:last] for x in full], [x[last:] for x in full]
            anchor, part, fp, home = ready
            if len(anchor) < 2:
                continue
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[new, len(anchor)])
            found = set()
            twos = new[size == 2]
            ok = (np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= max_bits) & (home[twos] | home[twos + 1])
            found.update(zip(fp[twos[ok]].view(np.int64).tolist(), fp[twos[ok] + 1].view(np.int64).tolist()))
            for start, n in zip(new[size > 2].tolist(), size[size > 2].tolist()):
                own = fp[start : start + n]
                signed = own.view(np.int64)
                found.update((int(signed[a]), int(signed[b])) for a, b in link_forest(own, home[start : start + n], max_bits))
            if found:
                pairs = np.array(sorted(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _then_none(items: Iterable) -> Iterator:
    yield from items
    yield None


def _fingerprint_rows(shingle_words: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            prints = fingerprints(raw_texts(piece.column("text")), shingle_words, seed)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(prints.view(np.int64))], ["id", "fp"])

    return run


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy()
        for at in range(0, len(prints), 4096):
            own = prints[at : at + 4096]
            rows, keys, homes = anchor_rows(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows]), pa.array(homes)], ["anchor", "fp", "home"])


def near_links(prints: DataFrame, max_bits: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): a forest of the links at each anchor between the distinct longs of column ``fp``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the covering holds for at most 3 differing bits")
    n = reduce_rows(prints.sparkSession)
    rows = prints.mapInArrow(_anchors, "anchor long, fp long, home boolean")
    large = rows.groupBy("anchor").count().where(F.col("count") > group_rows).select("anchor", F.ceil(F.col("count") * 2 / group_rows).cast("int").alias("chunks"))
    large = cut_lineage(large)
    # fewer than rows / group_rows anchors are large: their list is short, and rows need not meet it by a shuffle
    large = near(large)
    whole = rows.join(large, "anchor", "left_anti").withColumn("part", F.lit(0).cast("long"))
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.least(x.cast("long"), own) * F.col("chunks") + F.greatest(x.cast("long"), own))
        dealt = rows.join(large, "anchor").withColumn("own", own).withColumn("pairs", F.array_except(pair, F.array(F.col("own") * F.col("chunks") + F.col("own"))))
        whole = whole.unionByName(dealt.select("anchor", "fp", "home", F.explode("pairs").alias("part")))
    dealt = whole.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part", "fp")
    return dealt.select("anchor", "part", "fp", "home").mapInArrow(_compare(max_bits), "a long, b long")


def _joined(nodes: DataFrame, max_bits: int, group_rows: int) -> DataFrame:
    """``nodes`` (fp, rep, c), and the least ``rep`` of each fingerprint's component as ``least``."""
    stars = connected_components(near_links(nodes.select("fp"), max_bits, group_rows), "a", "b")
    members = stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
    known = members.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "rep")
    least = known.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("size"))
    grouped = join_hot(known.select("fp", "root"), least, ["root"], "size", known.count()).select("fp", "least")
    return cut_lineage(nodes.join(grouped, "fp", "left").withColumn("least", F.coalesce("least", "rep")))


def simhash_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3, max_bits: int = 3, seed: int = 42, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits.  Null and wordless texts have fingerprint
    zero and link like any other.  Rows of equal id are each returned.  A row
    of null id is returned with the least known id of its component (null if
    there is none).  Other columns, whatever their names, are not read; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_fingerprint_rows(shingle_words, seed), "id long, fp long")
    rows = cut_lineage(rows)
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("c")))
    named = _joined(nodes, max_bits, group_rows).select("fp", F.col("least").alias("component_id"), "c")
    out = join_hot(rows, named, ["fp"], "c", rows.count())
    return out.select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3, max_bits: int = 3, seed: int = 42, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of ``docs``, one of each SimHash group, with the columns they came with.

    The row of least id stays, null ids last; of rows of that id the one
    whose text has the least hash, and of rows of equal id and text any one.
    Null and wordless texts are one group like any other.
    """
    name, mark = F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    prints = docs.select(F.struct(name.alias("id"), mark.alias("mark")).alias("id"), F.col(f"`{text}`").alias("text"))
    prints = prints.mapInArrow(_fingerprint_rows(shingle_words, seed), "id struct<id long, mark long>, fp long")
    rows = cut_lineage(prints.groupBy("id.id", "id.mark").agg(F.first("fp").alias("fp"), F.count("*").alias("copies")))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "mark")
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min(order).alias("rep"), F.count("*").alias("c")))
    named = _joined(nodes, max_bits, group_rows).select("fp", "least", "c")
    found = join_hot(rows, named, ["fp"], "c", rows.count())
    gone = cut_lineage(found.where(order != F.col("least")).select("id", "mark", "copies"))
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.max("copies").alias("most")).first()
    out = by_keys(docs, gone, {"id": name, "mark": mark}, "copies", total.n, kept=False)
    if (total.most or 0) < 2:
        return out
    # of equal rows one stays: rows that have an equal are taken apart, so that other texts are not moved
    twins = cut_lineage(rows.where("copies > 1").select("mark", "copies"))
    (twin,) = free_names(docs, "twin")
    single, double = (by_keys(out, twins, {"mark": mark}, "copies", total.n, kept) for kept in (False, True))
    return single.unionByName(double.withColumn(twin, mark).dropDuplicates([twin]).drop(twin))
