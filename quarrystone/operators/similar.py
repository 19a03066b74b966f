"""Near-duplicates with exact verification, and diverse ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.columns import cosine
from quarrystone.operators.closeness import FULL, JOINED, PAIR, near_links
from quarrystone.operators.components import connected_components
from quarrystone.operators.tables import cut_lineage, join_hot
from quarrystone.operators.tables import near as near_table

HASHES, ROWS = 64, 4


def shingles(rows: DataFrame, words: int) -> DataFrame:
    """(id, s) of rows (id, text): the sorted distinct hashes of the runs of ``words`` lower-case words.

    A shorter text is one run, and one without words has none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                w = (text or "").lower().split()
                found = {digest(" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))} if w else ()
                out.append(np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], ["id", "s"])

    return rows.select("id", "text").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, s array<long>")


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, keys) of (id, h, s) with no empty s: a key for each band of MinHash rows."""
    seeds = np.random.default_rng(13).integers(1, 1 << 63, (HASHES, 2), np.uint64) | np.uint64(1)
    for batch in batches:
        lists = batch.column("s")
        if not batch.num_rows:
            continue
        starts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1]].astype(np.int64)
        values = pc.list_flatten(lists).to_numpy().view(np.uint64)
        keys = np.zeros((batch.num_rows, HASHES // ROWS), np.uint64)
        for k, (a, b) in enumerate(seeds):
            mixed = values * a
            mixed ^= mixed >> np.uint64(32)
            least = np.minimum.reduceat(mixed * b, starts)
            keys[:, k // ROWS] = (keys[:, k // ROWS] + least + np.uint64(k)) * a
        bands = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), bands], ["id", "h", "keys"])


def band_bits(rows: int, per_bucket: int = 8) -> int:
    """Bits of a band's key, so that about ``per_bucket`` unrelated rows share a bucket whatever the table's size."""
    return max(6, math.ceil(math.log2(max(rows, 1) / per_bucket)))


def bands_for(agree: float, bits: int, miss: float) -> int:
    """How many bands of ``bits`` bits let a pair whose bits agree with probability ``agree`` share one, but for a chance of ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def _judged(pairs: DataFrame, items: DataFrame, near: Column) -> DataFrame:
    """The distinct pairs (a, b) whose payloads ``pa`` and ``pb`` are near; ids in many pairs meet their payload by broadcast."""
    pairs = cut_lineage(pairs.distinct())
    total = pairs.count()
    for side in ("a", "b"):
        uses = pairs.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("uses"))
        known = items.join(uses, "id").select(F.col("id").alias(side), "uses", F.col("payload").alias(f"p{side}"))
        pairs = join_hot(pairs, known, [side], "uses", total)
    return cut_lineage(pairs.where(near).select("a", "b"))


def bucket_pairs(left: DataFrame, right: DataFrame, chunk: int = 2048) -> DataFrame:
    """``left`` and ``right`` (bucket, and columns of their own) joined by bucket.

    Sides of a bucket over ``chunk`` rows are dealt out in chunks, and each
    pair of chunks is a key of its own, so no bucket fills a task.
    """
    parts = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / chunk).alias(name))
    size = cut_lineage(parts(left, "n_left").join(parts(right, "n_right"), "bucket").where("n_left > 1 OR n_right > 1"))

    def dealt(df: DataFrame, own: str, other: str, keys: tuple[str, str]) -> DataFrame:
        known = df.join(near_table(size), "bucket", "left").withColumn(keys[0], F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1).cast("long"))))
        return known.withColumn(keys[1], F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1).cast("long")) - 1))).drop("n_left", "n_right")

    return dealt(left, "n_left", "n_right", ("i", "j")).join(dealt(right, "n_right", "n_left", ("j", "i")), ["bucket", "i", "j"]).drop("i", "j")


def bucket_links(members: DataFrame, items: DataFrame, near: Column) -> DataFrame:
    """(a, b) links between items that share a bucket, enough of them to connect whatever any links would.

    ``members`` is (bucket, id) and ``items`` (id, payload); ``near`` judges
    payloads ``pa`` and ``pb``.  In each bucket the least item is compared with
    the others.  Those it links to are connected already; each of the others is
    compared with all that are left.  So a bucket of near copies costs one
    comparison a member, any number of items takes two rounds, and only items
    unlike their bucket's first cost more, in dealt chunk pairs.
    """
    members = cut_lineage(members.distinct())
    first = members.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(join_hot(members, first, ["bucket"], "n", members.count()).where("id != a").withColumnRenamed("id", "b"))
    star = _judged(met.select("a", "b"), items, near)
    rest = cut_lineage(met.join(star.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("bucket", F.col("b").alias("id"), F.coalesce("linked", F.lit(False)).alias("linked")))
    pairs = bucket_pairs(rest.where("NOT linked").select("bucket", F.col("id").alias("x")), rest.select("bucket", F.col("id").alias("y"), "linked"))
    pairs = pairs.where("x < y OR (linked AND x != y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return star.unionByName(_judged(pairs, items, near)).distinct()


def _classes(rows: DataFrame, kind: str, reps: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id) of each row (id, ``kind``), over links of representatives; a class is named by its least id."""
    stars = cut_lineage(connected_components(links, "a", "b").select(F.col("node").alias("rep"), "root"))
    named = reps.join(stars, "rep", "left").select(kind, F.coalesce("root", "rep").alias("class_id"))
    return rows.join(named, kind).select("id", "class_id")


def minhash_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(id, class_id) of every row with words: classes of texts connected by shingle sets of Jaccard ``least`` or more.

    Texts of one shingle set are one representative.  Shingle hashes are
    banded (16 bands of 4 rows, which a pair of Jaccard 0.8 misses with a
    chance of 2 in 10,000); pairs of a band are verified on whole sets, which
    are made again from the texts of those that share a band.
    """
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    hashed = shingles(texts, words).where(F.size("s") > 0).select("id", F.xxhash64("s").alias("h"), "s")
    rows = cut_lineage(hashed.mapInArrow(_marks, f"id {dict(texts.dtypes)['id']}, h long, keys array<long>"))
    base = cut_lineage(rows.groupBy("h").agg(F.min("id").alias("rep"), F.any_value("keys").alias("keys")))
    buckets = base.select(F.col("rep").alias("id"), F.explode("keys").alias("bucket"))
    shared = buckets.groupBy("bucket").count().where("count > 1").select("bucket")
    members = cut_lineage(buckets.join(shared, "bucket").select("bucket", "id"))
    # only these sets are looked at whole, so only they are written
    met = cut_lineage(base.join(members.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "h"))
    sets = shingles(texts.join(near_table(met.select("id").distinct()), "id", "left_semi"), words).select("id", F.xxhash64("s").alias("h"), F.col("s").alias("payload"))
    items = cut_lineage(sets.join(near_table(met), ["id", "h"], "left_semi"))
    if items.count() > met.count():  # equal rows
        items = items.dropDuplicates(["id", "h"])
    jaccard = F.size(F.array_intersect("pa", "pb")) / F.size(F.array_union("pa", "pb"))
    links = bucket_links(members, items.select("id", "payload"), jaccard >= least)
    return _classes(rows.select("id", "h"), "h", base.select("h", "rep"), links)


def _hyperplane_keys(bits: int, bands: int, seed: int):
    """A key for each band, of the sides of ``bits`` random planes that (id, payload)'s vector lies on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            vectors = np.array(batch.column("payload").to_pylist(), np.float64)
            if not len(vectors):
                continue
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(vectors.shape[1], bits * bands))
            signs = (vectors @ planes > 0).reshape(len(vectors), bands, bits)
            keys = signs @ (1 << np.arange(bits)) | (np.arange(bands) << bits)[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), bands)), pa.array(keys.ravel())], ["id", "bucket"])

    return run


def _vectors(vectors: DataFrame, item: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(id, payload) of the rows with id and vector, and (id, payload, copies) of the distinct vectors, named by their least id."""
    rows = _able(vectors, item, vector)
    return rows, cut_lineage(rows.groupBy("payload").agg(F.min("id").alias("id"), F.count("*").alias("copies")))


def _vector_buckets(base: DataFrame, least: float, miss: float, seed: int) -> DataFrame:
    """(id, bucket) of distinct vectors: as many bands as find a pair of cosine ``least`` but for a chance of ``miss``."""
    bits = band_bits(base.count())
    bands = bands_for(1 - math.acos(least) / math.pi, bits, miss)
    return cut_lineage(base.select("id", "payload").mapInArrow(_hyperplane_keys(bits, bands, seed), "id long, bucket long"))


def cosine_links(vectors: DataFrame, item: str, vector: str, least: float, miss: float = 0.001, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """(a, b, score) of all pairs of distinct vectors above ``least``, and (id, rep) of the rows that share a vector.

    Candidates share the signs of a band of random planes; a pair at the
    threshold is missed with a chance of ``miss``, and each is verified.  The
    planes of a band grow with the logarithm of the rows.
    """
    rows, base = _vectors(vectors, item, vector)
    keys = _vector_buckets(base, least, miss, seed)
    pairs = bucket_pairs(keys.select("bucket", F.col("id").alias("a")), keys.select("bucket", F.col("id").alias("b"))).where("a < b").select("a", "b").distinct()
    side = lambda n: base.select(F.col("id").alias(n), F.col("payload").alias(f"p{n}"))
    judged = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", cosine("pa", "pb").alias("score"))
    return judged.where(F.col("score") > least), rows.join(base.select("payload", F.col("id").alias("rep")), "payload").select("id", "rep")


def _able(vectors: DataFrame, item: str, vector: str) -> DataFrame:
    """(id, payload) of the rows with id and vector."""
    return vectors.where(F.col(vector).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("id"), F.col(vector).alias("payload"))


def cosine_classes(vectors: DataFrame, item: str, vector: str, least: float) -> DataFrame:
    """(id, class_id): rows connected by cosines above ``least``, of all pairs; vectors without length are one class."""
    rows = _able(vectors, item, vector)
    stars = connected_components(near_links(rows, least, strict=True), "a", "b").select(F.col("node").alias("id"), "root")
    return rows.select("id").join(stars, "id", "left").select("id", F.coalesce("root", "id").alias("class_id"))


def dbscan(vectors: DataFrame, item: str, vector: str, least: float, min_points: int = 4) -> DataFrame:
    """(id, class_id, kind) of each row by DBSCAN, neighbours being vectors of cosine ``least`` or more.

    A core row has ``min_points`` rows or more around it, itself and its
    copies included; classes are the components of core rows and are named by
    their least id.  A border row takes the least class among its core
    neighbours; noise has no class.  Rows that share a vector fare alike.

    All pairs are compared.  Pairs of rows that are full, so core, come as a
    link for each; of all other rows every pair is known, so they are counted.
    """
    rows = _able(vectors, item, vector)
    found = near_links(rows, least, need=max(1, min_points - 1))
    links = found.where(F.col("what") == PAIR).select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.groupBy(F.col("a").alias("id")).agg((F.count("*") + 1).alias("around"))
    full = found.where(F.col("what") == FULL).select(F.col("a").alias("id"), F.lit(max(2, min_points)).cast("long").alias("around"))
    if min_points <= 1:
        full = rows.select("id", F.lit(1).cast("long").alias("around"))
    core = cut_lineage(counted.unionByName(full).groupBy("id").agg(F.max("around").alias("around")).where(F.col("around") >= min_points).select("id"))
    cores = lambda side: core.select(F.col("id").alias(side))
    joined = links.join(cores("a"), "a", "left_semi").join(cores("b"), "b", "left_semi").select("a", "b").unionByName(found.where(F.col("what") == JOINED).select("a", "b"))
    roots = connected_components(joined, "a", "b").select(F.col("node").alias("id"), "root")
    named = cut_lineage(core.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("class_id")))
    border = both.join(cores("a"), "a", "left_anti").join(named.select(F.col("id").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("class_id"))
    kinds = named.withColumn("kind", F.lit("core")).unionByName(border.withColumn("kind", F.lit("border")))
    return rows.select("id").join(kinds, "id", "left").select("id", "class_id", F.coalesce("kind", F.lit("noise")).alias("kind"))


class _WordHashes(dict):
    """The 64-bit hash of each word met."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _run_hashes(texts: list, words: int, known: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's runs, as ``shingles`` takes them, sorted within the text, and how many it has."""
    codes, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = (text or "").lower().split()
        lengths[i] = len(own)
        codes.extend(map(known.__getitem__, own))
    codes = np.array(codes, np.uint64)
    runs = np.where(lengths > 0, np.maximum(1, lengths - words + 1), 0)
    owner = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(np.cumsum(lengths) - lengths, runs)
    ends = np.cumsum(lengths)[owner]
    value = np.full(len(owner), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words):
        inside = at + k < ends
        mixed = (value[inside] ^ codes[at[inside] + k]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        value[inside] = mixed ^ (mixed >> np.uint64(32))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    return value[new], np.bincount(owner[new], minlength=len(texts))


#: Counters for the frequencies of runs, and how many are in a row; texts that are hashed at once, and their bytes.
SLOTS, _BLOCK, _TEXTS, _BYTES = 1 << 20, 1 << 14, 2048, 1 << 20


def _slots(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(30)).astype(np.int64) & (SLOTS - 1)


def _text_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            full = np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, "right")
            end = max(at + 1, min(at + _TEXTS, int(full), batch.num_rows))
            yield batch.slice(at, end - at)
            at = end


def run_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many runs of all ``texts`` (text) fall to each of SLOTS counters; a table of fixed size whatever the data's."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _WordHashes(), np.zeros(SLOTS, np.int64)
        for batch in _text_slices(batches):
            total += np.bincount(_slots(_run_hashes(batch.column("text").to_pylist(), words, known)[0]), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS // _BLOCK), pa.int32()), pa.array(list(total.reshape(-1, _BLOCK)), pa.list_(pa.int64()))], ["block", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = rows["counts"].combine_chunks().flatten().to_numpy().reshape(-1, _BLOCK).sum(0)
        return pa.table({"block": rows["block"][:1], "counts": pa.array([total], pa.list_(pa.int64()))})

    blocks = texts.select("text").mapInArrow(count, "block int, counts array<long>").groupBy("block").applyInArrow(add, "block int, counts array<long>").toArrow()
    out = np.zeros((SLOTS // _BLOCK, _BLOCK), np.int64)
    for block, counts in zip(blocks["block"].to_pylist(), blocks["counts"].combine_chunks()):
        out[block] = counts.values.to_numpy()
    return np.minimum(out.ravel(), (1 << 31) - 1).astype(np.int32)


def _brief(words: int, least: float, counts):
    """(name, id, n, m0, m1, payload) of each (name, text) with words, for ``_rare_runs``.

    ``id`` names the set of runs and ``n`` is its size; ``payload`` has those
    by which it meets others, rarest first; ``m0`` and ``m1`` hold a bit that
    each run flips, so two sets differ in as many runs as bits at least.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in _text_slices(batches):
            values, n = _run_hashes(batch.column("text").to_pylist(), words, known)
            some = np.flatnonzero(n)
            n = n[some]
            if not len(n):
                continue
            ends = np.cumsum(n)
            starts = ends - n
            ids = np.array([xxhash.xxh64_intdigest(values[s:e].tobytes()) for s, e in zip(starts, ends)], np.uint64).view(np.int64)
            bits = values & np.uint64(127)
            flips = np.uint64(1) << (bits & np.uint64(63))
            marks = [np.bitwise_xor.reduceat(np.where(bits >> np.uint64(6) == k, flips, np.uint64(0)), starts).view(np.int64) for k in (0, 1)]
            order = np.lexsort((values, counts.value[_slots(values)], np.repeat(np.arange(len(n)), n)))
            first = n - np.floor(n * least - 1e-9).astype(np.int64)
            payload = values[order][np.arange(len(values)) - np.repeat(starts, n) < np.repeat(first, n)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(first)].astype(np.int32)), pa.array(payload))
            yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(some)), pa.array(ids), pa.array(n), *map(pa.array, marks), lists], ["name", "id", "n", "m0", "m1", "payload"])

    return run


def _whole(words: int):
    """(id, payload): all runs of each (text), under the name that ``_brief`` gives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in _text_slices(batches):
            values, n = _run_hashes(batch.column("text").to_pylist(), words, known)
            ends = np.cumsum(n)
            ids = np.array([xxhash.xxh64_intdigest(values[e - k : e].tobytes()) for e, k in zip(ends, n)], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["id", "payload"])

    return run


def _rare_runs(sets: DataFrame, least: float) -> DataFrame:
    """(bucket, id): the shingles by which sets (id, payload) of a Jaccard above ``least`` are sure to meet.

    Such sets share over ``least`` of each, so in one order of all shingles,
    in which every payload is, they share one of the first n - floor(least * n)
    of each.  A payload may end after these, if ``n`` has the set's size.
    Shingles that one set alone has there are left out; other columns stay.
    """
    n = F.col("n") if "n" in sets.columns else F.size("payload")
    first = sets.withColumn("bucket", F.explode(F.slice("payload", F.lit(1), (n - F.floor(n * least - 1e-9)).cast("int")))).drop("payload")
    shared = cut_lineage(first.groupBy("bucket").count().where("count > 1").select("bucket"))
    return first.join(near_table(shared), "bucket", "left_semi")


def _able_pairs(least: float, x: str, y: str) -> Column:
    """Whether the sizes and bits of sets leave a Jaccard above ``least`` possible."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    bits = sum(F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in ("m0", "m1"))
    return (F.least(f"{x}.n", f"{y}.n") >= F.greatest(f"{x}.n", f"{y}.n") * least - 1e-9) & (bits <= both * ((1 - least) / (1 + least)) + 1e-9)


def _set_links(members: DataFrame, least: float, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) links between sets (bucket, id, n, m0, m1) that share a bucket, enough of them to connect whatever any links would.

    The least set of each bucket is compared with the others, then those that
    are not connected yet with each other, in dealt chunk pairs.  Only pairs
    that sizes and bits allow are written, and only their sets, ``whole`` of
    (id), are compared.
    """
    jaccard = F.size(F.array_intersect("pa", "pb")) / F.size(F.array_union("pa", "pb"))
    own = F.struct("id", "n", "m0", "m1")

    def judged(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
        asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        return _judged(pairs, whole(asked), jaccard > least)

    first = members.groupBy("bucket").agg(F.min(own).alias("x"), F.count("*").alias("n"))
    met = join_hot(members.select("bucket", own.alias("y")), first, ["bucket"], "n", members.count())
    star = judged(met.where((F.col("x.id") != F.col("y.id")) & _able_pairs(least, "x", "y")))
    roots = connected_components(star, "a", "b").select(F.col("node").alias("id"), "root")
    # a root has no row for itself and is in as many rows as its buckets
    known = cut_lineage(members.join(near_table(roots), "id", "left").select("bucket", F.struct("id", "n", "m0", "m1", F.coalesce("root", "id").alias("root")).alias("x")))
    pairs = bucket_pairs(known, known.withColumnRenamed("x", "y"), 8192)
    rest = judged(pairs.where((F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & _able_pairs(least, "x", "y")))
    return star.unionByName(rest)


def simhash_chunks(chunks: DataFrame, text: str, least: float = 0.85, words: int = 3) -> DataFrame:
    """(text_hash, copies, class_id, kept): distinct chunk texts with words, met by their rarest shingles and compared in pairs; of a class the most frequent stays.

    Different shingle sets are met at the shingles that come first in an order
    of rarity (``_rare_runs``), so no pair above ``least`` is missed, and
    compared whole.  What is written of a text is its names, size and these
    shingles, about a sixth; sets of likely pairs are made again from the
    texts.  Names are md5 of the text, a class has its least one, and ties of
    frequency go to the least.
    """
    texts = chunks.where(F.col(text).isNotNull()).select(F.unhex(F.md5(text)).alias("name"), F.col(text).alias("text"))
    counts = chunks.sparkSession.sparkContext.broadcast(run_counts(texts, words))
    brief = texts.mapInArrow(_brief(words, least, counts), "name binary, id long, n long, m0 long, m1 long, payload array<long>")
    rest = ("id", "n", "m0", "m1", "payload")
    rows = cut_lineage(brief.groupBy("name").agg(F.count("*").alias("copies"), F.first(F.struct(*rest)).alias("r")).select("name", "copies", "r.*"))
    members = cut_lineage(_rare_runs(rows.select(*rest), least).dropDuplicates(["bucket", "id"]))

    def whole(asked: DataFrame) -> DataFrame:
        names = cut_lineage(rows.join(near_table(asked), "id", "left_semi").groupBy("id").agg(F.min("name").alias("name")))
        found = texts.join(near_table(names.select("name")), "name", "left_semi")
        return cut_lineage(found.select("text").mapInArrow(_whole(words), "id long, payload array<long>").dropDuplicates(["id"]))

    links = _set_links(members, least, whole)
    roots = connected_components(links, "a", "b").select(F.col("node").alias("id"), "root")
    named = cut_lineage(rows.select("name", "copies", "id").join(near_table(roots), "id", "left").select("name", "copies", F.coalesce("root", "id").alias("root")))
    best = named.groupBy("root").agg(F.min(F.struct((-F.col("copies")).alias("minus"), F.col("name").alias("best"))).alias("b"), F.min("name").alias("class"))
    hexed = lambda c: F.lower(F.hex(c))
    return named.join(best, "root").select(hexed("name").alias("text_hash"), "copies", hexed("class").alias("class_id"), (F.col("name") == F.col("b.best")).alias("kept"))


def best_of_class(classes: DataFrame, quality: DataFrame) -> DataFrame:
    """(class_id, id, size): of each class the row of best ``quality`` (id, quality), and the class's number of rows."""
    rated = classes.join(quality, "id", "left").groupBy("class_id")
    return rated.agg(F.min(F.struct((-F.coalesce("quality", F.lit(-1e300))).alias("minus"), "id")).alias("b"), F.count("*").alias("size")).select("class_id", "b.id", "size")


def top_scored(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The ``k`` best rows of each query, ties by item: ranks are cut within each task before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mmr(candidates: DataFrame, query: str, item: str, score: str, vector: str, k: int = 5, weight: float = 0.7) -> DataFrame:
    """(query, item, position): greedy maximal marginal relevance over each query's candidates."""
    kinds = dict(candidates.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.sort_values([score, item], ascending=[False, True])[[item, score, vector]].values.tolist()
        taken: list = []
        while left and len(taken) < k:
            best = max(left, key=lambda c: (weight * c[1] - (1 - weight) * max((sum(a * b for a, b in zip(c[2], t[2])) for t in taken), default=0.0), -c[0]))
            left.remove(best)
            taken.append(best)
        return pd.DataFrame({query: rows[query].iloc[0], item: [t[0] for t in taken], "position": range(1, len(taken) + 1)})

    return candidates.groupBy(query).applyInPandas(run, f"{query} {kinds[query]}, {item} {kinds[item]}, position int")
