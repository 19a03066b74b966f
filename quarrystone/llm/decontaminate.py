"""Benchmark decontamination by template canonicalisation.

Numbers, units beside numbers, and names are replaced by typed placeholders,
so that a question asked again with other values has the same template.  A
capital after a sentence end may or may not be a name, so the first word of a
sentence has a placeholder of its own, whatever it is.

Windows of ``WINDOW`` template tokens are hash-joined between documents and
benchmark items.  Hits that lie near one diagonal (document position minus
item position) are one chain, so a word put in or left out does not split it.
A chain counts if it has enough of the item's windows and its slots agree: an
item's name stands for one name in the document, and no two for the same; for
numbers and units chance may make equal values differ.

Items of one template and one pattern of equal slots are one class with a
representative, as a document that holds one holds all.  A chain needs r of an
item's m windows, so one of the m - r + 1 windows that fewest classes have
must be hit: only these look for candidates, and a phrase that many items
share does not pair each of them with each document that has it.

Items with few such windows are sought by their whole template: all of its
windows in one chain, and, if it is very short, from a sentence's start to a
sentence's end.  Items whose template says too little (few plain words) are
sought by all of their words from a sentence's start to a sentence's end.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, raw_texts
from quarrystone.llm.substrings import run_hashes
from quarrystone.operators.tables import by_keys, cut_lineage, near

#: Template tokens in a window, and the least of them that are plain words.
WINDOW, LEAST_PLAIN = 5, 3
#: Least share of an item's windows in a chain, and least number of them; items with fewer such windows are sought whole.
LEAST_SHARE, LEAST_WINDOWS = 0.5, 4
#: Least template tokens of an item that is sought by its whole template, and of one that need not be a sentence of its own.
LEAST_WORDS, LEAST_FREE = 5, 8
#: Least share of a chain's slots that agree, of names and of numbers and units.
LEAST_NAMES, LEAST_NUMBERS = 0.8, 0.5
#: Most distinct benchmark windows that are broadcast (8 bytes each); with more, all document windows are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
# Words that are units beside a number, and words that are numbers.
UNITS = frozenset("mm cm m km in ft mi mg g kg t lb oz ml cl l s sec min h hr ms bytes kb mb gb tb px usd eur gbp hz khz mhz ghz w kw mw v kv percent dollars dollar euros euro cents cent pounds pound meters meter metres metre kilometers kilometer kilometres kilometre miles mile feet foot inches inch grams gram kilograms kilogram tons ton liters liter litres litre seconds second minutes minute hours hour days day weeks week months month years year degrees degree".split())
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
_TOKEN = re.compile(r"\d[\d.,:/]*|[^\W\d_]+(?:['’][^\W\d_]+)?|[%$€£]|[.!?:;]")
_PLAIN, _CAPITAL, _NUMBER, _UNIT, _END, _WORDED, _SIGN = range(7)
_NUM, _MEASURE, _NAME, _FIRST, _RAW = (np.uint64(x) for x in (0x1D8E4E27C47D124F, 0x3C79AC492BA7B653, 0x1C69B3F74AC4AE35, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D))
#: Marks of a window's key: at a sentence's start, and at a sentence's end.
_OPEN, _CLOSE = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
_CACHE = 50_000
#: Bytes of text whose template tokens are held at a time, in about twenty times as many bytes.
PIECE_BYTES = 1 << 20


def _code(token: str) -> int:
    """Hash of the folded token with its kind in the low three bits."""
    low = token.lower()
    if token[0].isdigit():
        kind = _NUMBER
    elif token in ".!?:;":
        kind = _END
    elif token in "%$€£":
        kind = _SIGN
    elif low in UNITS:
        kind = _UNIT
    elif low in NUMBER_WORDS:
        kind = _WORDED
    else:
        kind = _CAPITAL if token[0].isupper() and not (len(token) > 1 and token.isupper()) else _PLAIN
    return (xxhash.xxh64_intdigest(low.encode(), 17) & ~7) | kind


class _Codes(dict):
    """The codes of each word's tokens as bytes."""

    def __missing__(self, word: str) -> bytes:
        found = np.array([_code(t) for t in _TOKEN.findall(word)], np.uint64).tobytes()
        if len(self) < _CACHE:
            self[word] = found
        return found


def _body(raw: bytes) -> str:
    """The text with line ends as sentence ends."""
    return raw.decode("utf-8").replace("\n", " . ")


_START = np.array([_END], np.uint64).tobytes()


class Templates:
    """The template tokens of many texts, one after the other."""

    def __init__(self, bodies: list[str], codes: _Codes):
        self.bodies = bodies
        look = codes.__getitem__
        parts = [_START + b"".join(map(look, body.split())) for body in bodies]
        sizes = np.array([len(p) // 8 for p in parts], np.int64)
        flat = np.frombuffer(b"".join(parts), np.uint64)
        text = np.repeat(np.arange(len(parts)), sizes)
        kind = (flat & np.uint64(7)).astype(np.int8)
        before, after = np.r_[np.int8(_END), kind[:-1]], np.r_[kind[1:], np.int8(_END)]
        counts = lambda k: (k == _NUMBER) | (k == _WORDED)
        capital = kind == _CAPITAL
        first = capital & (before == _END)
        unit = ((kind == _UNIT) | (kind == _SIGN)) & counts(before) | (kind == _SIGN) & counts(after)
        # "Ann Lee" is one name, "two hundred" one number
        again = capital & (before == _CAPITAL) | (kind == _WORDED) & counts(before)
        hashes = flat & ~np.uint64(7)
        raw = hashes.copy()
        hashes[capital], hashes[first], hashes[counts(kind)], hashes[unit] = _NAME, _FIRST, _NUM, _MEASURE
        kept = np.flatnonzero((kind != _END) & ~again)
        self.hashes, self.text, self.at = hashes[kept], text[kept], kept
        #: n, d and u for names, numbers and units, 0 for plain words
        self.marks = np.select([capital[kept], counts(kind)[kept], unit[kept]], [ord("n"), ord("d"), ord("u")], 0)
        words = np.flatnonzero(kind != _END)
        self.raw, self.raw_text = raw[words], text[words]
        # whether a sentence begins with the token, of template tokens and of words; past the last one, one begins
        self.opens, self.raw_opens = np.r_[before[kept] == _END, True], np.r_[before[words] == _END, True]
        self.starts = np.searchsorted(self.text, np.arange(len(parts) + 1))
        self.raw_starts = np.searchsorted(self.raw_text, np.arange(len(parts) + 1))
        self.begins = np.cumsum(sizes) - sizes
        self.tokens: dict[int, list[str]] = {}

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, key) of each window that lies in one text."""
        return self._runs(self.hashes, self.text, length)

    def raw_windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of the words as they are."""
        at, keys = self._runs(self.raw, self.raw_text, length)
        return at, keys ^ _RAW

    def edged(self, raw: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, key) of the windows, and again, under keys of their own, of those at a sentence's start, at its end, and at both."""
        at, keys = self.raw_windows(length) if raw else self.windows(length)
        opens = (self.raw_opens if raw else self.opens)[at]
        closes = (self.raw_opens if raw else self.opens)[at + length]
        for some, mark in ((opens, _OPEN), (closes, _CLOSE), (opens & closes, _OPEN ^ _CLOSE)):
            yield at[some], keys[some] ^ mark

    @staticmethod
    def _runs(hashes: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        keys = run_hashes(hashes, length)
        at = np.flatnonzero(text[: len(keys)] == text[length - 1 :]) if len(keys) else np.zeros(0, np.int64)
        return at, keys[at] * np.uint64(length)

    def slots(self, start: int, stop: int) -> list[tuple[int, str]]:
        """(place in the window, kind and folded value) of each slot of the template tokens from start to stop."""
        out = []
        for i in range(start, stop):
            if self.marks[i]:
                row = int(self.text[i])
                if row not in self.tokens:
                    self.tokens[row] = _TOKEN.findall(self.bodies[row])
                found, low = self.tokens[row], int(self.at[i] - self.begins[row]) - 1
                high = int(self.at[i + 1] - self.begins[row]) - 1 if i + 1 < len(self.at) and self.text[i + 1] == row else len(found)
                out.append((i - start, chr(self.marks[i]) + " ".join(t for t in found[low:high] if t not in ".!?:;").lower().rstrip(".,:/")))
        return out


def _value_hash(slots: list[tuple[int, str]]) -> int:
    return xxhash.xxh64_intdigest("\n".join(v for _, v in slots).encode(), 5) - (1 << 63)


_ITEM = "k long, raw int, size int, edged boolean, form long, item long, ipos int, windows int, need int, slots array<struct<p: int, v: string>>, vhash long"
_SLOT = pa.list_(pa.struct([("p", pa.int32()), ("v", pa.string())]))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([[{"p": p, "v": v} for p, v in x] for x in c] if t == _SLOT else c, t) for c, t in zip(columns, kinds)], names)


def _signed(key: np.ndarray) -> list[int]:
    return key.view(np.int64).tolist()


def _sentence(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a whole item, the first at a sentence's start and the last at its end."""
    keys = keys.copy()
    keys[0] ^= _OPEN
    keys[-1] ^= _CLOSE
    return at, keys


def _item_rows(window: int, least_plain: int, least_share: float, least_windows: int, least_words: int, least_free: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for piece in pieces(batches, "text"):
            out = []
            for item, raw in zip(piece.column("item").to_pylist(), raw_texts(piece.column("text"))):
                own = Templates([_body(raw)], codes)
                at, keys = own.windows(window)
                able = [i for i in at if (own.marks[i : i + window] == 0).sum() >= least_plain]
                if not len(own.raw):
                    continue
                size, edged, need = window, False, max(math.ceil(least_share * len(able)), least_windows)
                if len(able) < least_windows and len(own.hashes) >= least_words and (own.marks == 0).sum() >= least_plain:  # its whole template
                    size, edged = min(window, len(own.hashes)), len(own.hashes) < least_free
                    at, keys = own.windows(size)
                    able, need = list(at), len(at)
                elif len(able) < least_windows:  # too little to tell by its template: all of its words
                    form = int(run_hashes(own.raw, len(own.raw)).view(np.int64)[0])
                    size = min(window, len(own.raw))
                    at, keys = _sentence(*own.raw_windows(size))
                    out += [(k, 1, size, True, form, item, int(i), len(at), len(at), [], 0) for i, k in zip(at, _signed(keys))]
                    continue
                if edged:
                    at, keys = _sentence(at, keys)
                slots = own.slots(0, len(own.hashes))
                seen: dict[str, int] = {}
                pattern = [(p, seen.setdefault(v, len(seen))) for p, v in slots]
                form = xxhash.xxh64_intdigest(own.hashes.tobytes() + repr(pattern).encode(), 3) - (1 << 63)
                for i in able:
                    these = own.slots(i, i + size)
                    row = (form, item, int(i), len(able), need, these, _value_hash(these))
                    out.append((_signed(keys[i : i + 1])[0], 0, size, edged, *row))
                    if i == 0 and not edged and own.hashes[0] == _FIRST:  # inside a sentence the item's first word is a name or a plain word
                        for reading in (_NAME, own.raw[0]):
                            other = own.hashes[:size].copy()
                            other[0] = reading
                            here = these if reading == _NAME else [x for x in these if x[0]]
                            out.append((_signed(run_hashes(other, size) * np.uint64(size))[0], 0, size, edged, *row[:5], here, _value_hash(here)))
            yield _batch(out, _ITEM_NAMES, [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), _SLOT, pa.int64()])

    return run


_ITEM_NAMES = [part.split()[0] for part in _ITEM.replace("p: int, ", "").split(", ")]
_HIT = "k long, doc long, row long, dpos int, slots array<struct<p: int, v: string>>, vhash long"


def _doc_rows(shapes: list[tuple[int, int, bool]], shared):
    """Windows of the texts, of each shape (of words, length, at sentence ends); only those of a known hash if ``shared`` is given."""
    plain = sorted({(raw, size) for raw, size, _ in shapes})
    at_ends = sorted({(raw, size) for raw, size, edged in shapes if edged})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        known = shared.value if shared is not None else None

        def met(keys: np.ndarray) -> np.ndarray:
            if known is None:
                return np.arange(len(keys))
            if not len(known):
                return np.zeros(0, np.int64)
            spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return np.flatnonzero(known[spot] == keys)

        for piece in pieces(batches, "text", most_bytes=PIECE_BYTES):
            own = Templates([_body(x) for x in raw_texts(piece.column("text"))], codes)
            docs, rows, out = piece.column("doc").to_pylist(), piece.column("row").to_pylist(), []
            found = [(raw, size, own.raw_windows(size) if raw else own.windows(size)) for raw, size in plain]
            found += [(raw, size, more) for raw, size in at_ends for more in own.edged(raw, size)]
            for raw, size, (at, keys) in found:
                text, starts = (own.raw_text, own.raw_starts) if raw else (own.text, own.starts)
                for x in met(keys):
                    i = int(at[x])
                    t = int(text[i])
                    slots = [] if raw else own.slots(i, i + size)
                    out.append((_signed(keys[x : x + 1])[0], docs[t], rows[t], i - int(starts[t]), slots, 0 if raw else _value_hash(slots)))
            yield _batch(out, ["k", "doc", "row", "dpos", "slots", "vhash"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), _SLOT, pa.int64()])

    return run


def slots_agree(pairs: list[tuple[int, str, str]], least_names: float = LEAST_NAMES, least_numbers: float = LEAST_NUMBERS) -> bool:
    """Whether the (place, item value, document value) of a chain's slots hang together.

    A slot agrees if its item value stands for this document value more often
    than for any other, and, of names, no other item name does so more often.
    """
    for names, least in ((True, least_names), (False, least_numbers)):
        own = {(p, i, d) for p, i, d in pairs if (i[0] == "n") == names}
        if not own:
            continue
        times = Counter((i, d) for _, i, d in own)
        of_item: dict[str, tuple[int, str]] = defaultdict(lambda: (0, ""))
        of_doc: dict[str, tuple[int, str]] = defaultdict(lambda: (0, ""))
        for (i, d), n in sorted(times.items()):
            of_item[i] = max(of_item[i], (n, d))
            of_doc[d] = max(of_doc[d], (n, i))
        agree = sum(n for (i, d), n in times.items() if of_item[i][1] == d and (not names or of_doc[d][1] == i))
        if agree < least * len({p for p, _, _ in own}):
            return False
    return True


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [slots_agree([(x["p"], x["i"], x["d"]) for x in own]) for own in batch.column("pairs").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["pairs"])


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))


def unsearched_items(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id) of the items without a word, which alone are not sought."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            few = [not len(Templates([_body(x)], _Codes()).raw) for x in raw_texts(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("item").filter(pa.array(few, pa.bool_()))], ["item_id"])

    return _items(benchmark, item_id, item_text).mapInArrow(run, "item_id long")


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, least_plain: int = LEAST_PLAIN, least_share: float = LEAST_SHARE, least_windows: int = LEAST_WINDOWS,
    least_words: int = LEAST_WORDS, least_free: int = LEAST_FREE, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(id, item_id, n_items, share, n_windows, verbatim, row) for each document and class of items that it holds.

    A class is named by its least item_id; ``n_items`` counts its items.
    ``share`` is the greatest share of the item's windows in one chain whose
    slots agree.  ``verbatim`` says that all slot values there are those of an
    item of the class.  ``row`` is xxhash64(id, text), which tells rows of
    null or equal id apart; equal rows give one result.  Items with fewer than
    ``least_windows`` windows of ``least_plain`` plain words are found by their
    whole template, those of under ``least_free`` tokens as sentences of their
    own; of under ``least_words`` tokens or ``least_plain`` plain words, by all
    their words as sentences of their own.  Null and empty texts hold nothing; an empty table on either
    side gives an empty result.  Very long texts are read whole.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    items = _items(benchmark, item_id, item_text).mapInArrow(_item_rows(window, least_plain, least_share, least_windows, least_words, least_free), _ITEM)
    items = cut_lineage(items)
    classes = items.groupBy("form").agg(F.min("item").alias("rep"), F.countDistinct("item").alias("n_items"))
    members = items.where("raw = 0").select("form", "ipos", "vhash").distinct().withColumn("same", F.lit(True))
    own = items.join(near(cut_lineage(classes)), "form").where(F.col("item").eqNullSafe(F.col("rep"))).dropDuplicates(["form", "k", "ipos"])
    own = cut_lineage(own.drop("item", "vhash"))
    shapes = [(r.raw, r["size"], r.edged) for r in own.select("raw", "size", "edged").distinct().collect()]  # at most four of each length up to ``window``
    shared = None
    distinct = own.select("k").distinct()
    if distinct.limit(broadcast_windows + 1).count() <= broadcast_windows:
        shared = spark.sparkContext.broadcast(np.unique(np.array([r.k for r in distinct.collect()], np.int64).view(np.uint64)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))
    hits = rows.mapInArrow(_doc_rows(shapes, shared), _HIT)
    if shared is None:
        hits = hits.join(distinct, "k", "left_semi")
    hits = cut_lineage(hits)
    # the windows that fewest classes have look for candidates, so many that a chain cannot miss them all
    spread = own.groupBy("k").agg(F.countDistinct("form").alias("classes"))
    rare = own.join(near(cut_lineage(spread)), "k").groupBy("form", "ipos", "windows", "need").agg(F.max("classes").alias("classes"))
    place = F.row_number().over(Window.partitionBy("form").orderBy("classes", "ipos"))
    rare = rare.withColumn("place", place).where(F.col("place") <= F.col("windows") - F.col("need") + 1).select("form", "ipos")
    probes = cut_lineage(own.join(rare, ["form", "ipos"]).select("k", "form").distinct())
    found = hits.select("row", "k").join(near(probes), "k").select("row", "form").distinct()
    met = found.join(near(own.withColumnRenamed("slots", "item_slots")), "form").join(hits, ["row", "k"])
    met = met.join(near(cut_lineage(members)), ["form", "ipos", "vhash"], "left")
    # hits of one diagonal, and of two sets of bands that overlap by half
    line, band = F.col("dpos") - F.col("ipos"), F.greatest(F.lit(8), F.floor(F.col("windows") / 4))
    chains = F.array(F.struct(F.lit(0).alias("kind"), line.cast("long").alias("spot")), *[F.struct(F.lit(i).alias("kind"), F.floor((line + shift) / band).alias("spot")) for i, shift in ((1, F.lit(0)), (2, band / 2))])
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct((F.col("ipos") + z["item_slots"]["p"]).alias("p"), z["item_slots"]["v"].alias("i"), z["slots"]["v"].alias("d")))
    same = F.coalesce("same", F.col("raw") > 0)
    met = met.select("doc", "row", "form", "rep", "n_items", "windows", "need", "ipos", same.alias("same"), pairs.alias("pairs"), F.explode(chains).alias("chain"))
    one = met.groupBy("doc", "row", "form", "rep", "n_items", "windows", "need", "chain").agg(
        F.size(F.collect_set("ipos")).alias("n_windows"), F.min("same").alias("verbatim"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )
    one = one.where("n_windows >= need").select("doc", "row", "form", "rep", "n_items", (F.col("n_windows") / F.col("windows")).alias("share"), "n_windows", "verbatim", "pairs")
    one = one.mapInArrow(_agreeing, "doc long, row long, form long, rep long, n_items long, share double, n_windows int, verbatim boolean")
    best = one.groupBy("doc", "row", "form", "rep", "n_items").agg(F.max(F.struct("share", "verbatim", "n_windows")).alias("b"))
    return best.select(F.col("doc").alias(doc_id), F.col("rep").alias("item_id"), "n_items", "b.share", "b.n_windows", "b.verbatim", "row")


def drop_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; equal rows go or stay together."""
    bad = cut_lineage(leaks.select("row").distinct().withColumn("times", F.lit(1)))
    return by_keys(docs, bad, {"row": F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))}, "times", 1, kept=False)
