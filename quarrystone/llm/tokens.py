"""Token ids of documents, written to and read back from patched frame-of-reference shards."""

from __future__ import annotations

import json
import os
import string
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces
from quarrystone.llm.pfor import BLOCK, PERCENTILE, Shard, write_shard
from quarrystone.operators.tables import cut_lineage, fresh_dir, reduce_rows

#: A word that begins with white space or is empty.
_OPEN = r"^($|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"


def _splits_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer is a byte-level BPE without normaliser or other steps that look over a space."""
    before, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    bpe = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
    odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    return bool(plain and bpe and not odd and spec["normalizer"] is None and not spec["truncation"] and not spec["padding"])


class KeptWords:
    """Ids of the words that a worker meets, kept from one batch of texts to the next.

    ``encode`` gives all ids of distinct words and how many each has.  Beyond
    ``most`` words, the half met in most batches stays; words over 64 bytes
    are not kept.  What is kept changes the time only.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = 1 << 18):
        self.encode, self.most = encode, most
        self.words = pa.array([], pa.string())
        self.ids, self.counts, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, count): the ids of words[i] are ids[begin[i] : begin[i] + count[i]]."""
        at = pc.index_in(words, value_set=self.words.cast(words.type))
        unknown = pc.is_null(at)
        new = words.filter(unknown).dictionary_encode()
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[unknown.to_numpy(zero_copy_only=False)] = len(self.words) + new.indices.to_numpy()
        new_ids, new_counts = self.encode(new.dictionary)
        ids, counts = np.concatenate([self.ids, new_ids]), np.concatenate([self.counts, new_counts])
        begins = np.cumsum(counts) - counts
        self.met += np.bincount(place, minlength=len(self.met))[: len(self.met)] > 0
        self._keep(new.dictionary, new_ids, new_counts)
        return ids, begins[place], counts[place]

    def _keep(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(words), 64).to_numpy(zero_copy_only=False)
        short = short & (np.cumsum(short) <= self.most)
        self.words = pa.concat_arrays([self.words, words.filter(pa.array(short)).cast(pa.string())])
        self.ids = np.concatenate([self.ids, ids[np.repeat(short, counts)]])
        self.counts = np.concatenate([self.counts, counts[short]])
        self.met = np.concatenate([self.met, np.ones(short.sum(), np.int32)])
        if len(self.words) > self.most:
            stay = np.zeros(len(self.words), bool)
            stay[np.argpartition(-self.met, self.most // 2)[: self.most // 2]] = True
            self.words, self.ids = self.words.filter(pa.array(stay)), self.ids[np.repeat(stay, self.counts)]
            self.counts, self.met = self.counts[stay], (self.met[stay] + 1) // 2  # what was frequent long ago gives way


def text_encoder(vocabulary: str) -> Callable[[pa.Array], list[np.ndarray]]:
    """A function that gives each text's ids (u32), equal to encode(text, add_special_tokens=False).

    A byte-level BPE without normaliser starts a new pre-token at every space
    that stands before a letter or mark, so what lies between spaces can be
    encoded on its own.  The distinct words of many texts are found by Arrow's
    dictionary encoding; those not met before go to the tokenizers library,
    joined by spaces, and told apart by the ids whose token begins with a
    space.  Where
    a space meets more white space or the end, or a special token occurs,
    words may depend on their neighbours: the library gets the whole text.
    Any other kind of tokenizer gets all texts whole.  Nulls are empty.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task, as Spark counts
    import tokenizers
    from tokenizers import Tokenizer

    # a worker process runs many tasks: the vocabulary is read once for all of them
    held = tokenizers.__dict__.setdefault("_quarrystone_encoders", {})
    if vocabulary in held:
        return held[vocabulary]
    library = Tokenizer.from_file(vocabulary)
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    spaces = np.zeros(library.get_vocab_size(), bool)
    spaces[[i for token, i in library.get_vocab().items() if token.startswith("\u0120")]] = True

    def batch(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words with a space before each, and how many each has."""
        found, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 2048):
            part = words.slice(at, 2048).to_pylist()
            ids = batch([" " + " ".join(part)])[0]
            starts = np.flatnonzero(spaces[ids])
            if len(starts) == len(part):
                counts.append(np.diff(starts, append=len(ids)))
            else:  # some word is white space or special, and its text is encoded whole below
                each = batch([" " + w for w in part])
                ids = np.concatenate(each)
                counts.append(np.array([len(x) for x in each]))
            found.append(ids)
        return np.concatenate(found), np.concatenate(counts)

    if not _splits_at_spaces(json.loads(library.to_str())):
        held[vocabulary] = lambda texts: batch(pc.fill_null(texts, "").to_pylist())
        return held[vocabulary]

    kept = KeptWords(spaced)
    none = np.uint32(0xFFFFFFFF)

    def distinct(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, count, end, ends) of distinct words with a space before each.

        A word of letters shares its ids with the same word before punctuation,
        which is a pre-token of its own: row end[i] of ``ends`` (the first has
        none) holds the ids that follow, in reverse order.
        """
        stem = pc.utf8_rtrim(words, string.punctuation)
        more = pc.subtract(pc.binary_length(words), pc.binary_length(stem))
        one = pc.and_(pc.and_(pc.greater(more, 0), pc.less_equal(more, 8)), pc.utf8_is_alpha(stem))
        chosen = one.to_numpy(zero_copy_only=False)
        cut = pa.array([w[-n:] for w, n in zip(words.filter(one).to_pylist(), more.filter(one).to_pylist())], pa.string()).dictionary_encode()
        found = [[], *(x.tolist() for x in batch(cut.dictionary.to_pylist()))]
        end = np.zeros(len(words), np.int32)
        end[chosen] = cut.indices.to_numpy() + 1
        ends = np.array([x[::-1] + [none] * (8 - len(x)) for x in found], np.uint32)
        return *kept.look_up(pc.if_else(one, stem, words)), end, ends

    def encode(texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        stops = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        starts = np.r_[0, stops[:-1]]
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        firsts = batch(words.take(pa.array(place[starts])).to_pylist())
        ids, begins, counts, end, ends = distinct(words)
        held = np.zeros(len(words), bool)
        for x in special:
            held |= pc.match_substring(words, x).to_numpy(zero_copy_only=False)
        odd = held | pc.match_substring_regex(words, _OPEN).to_numpy(zero_copy_only=False)
        whole = np.add.reduceat(odd[place], starts, dtype=np.int64) - odd[place[starts]] > 0
        whole |= held[place[starts]]
        # a text's first word has no space before it, so it has an entry of its own
        place[starts] = len(words) + np.arange(len(firsts))
        own = np.array([len(x) for x in firsts], np.int64)
        begins = np.concatenate([begins, len(ids) + np.cumsum(own) - own])
        counts = np.concatenate([counts, own])
        end = np.concatenate([end, np.zeros(len(firsts), np.int32)])[place]
        after = (ends != none).sum(axis=1)[end]
        length = counts[place] + after
        stop = np.cumsum(length)
        # of a word with an end, too many ids are taken, and the end's put in their place
        ids = np.concatenate([ids, *firsts, np.zeros(ends.shape[1], np.uint32)])
        flat = np.empty(stop[-1], np.uint32)
        for at in range(0, len(place), 1 << 15):
            part = slice(at, at + (1 << 15))
            low, high = stop[at] - length[at], stop[part][-1]
            spot = np.repeat(begins[place[part]] - (stop[part] - length[part]), length[part])
            spot += np.arange(low, high)
            np.take(ids, spot, out=flat[low:high], mode="clip")
        for back in range(after.max()):
            at = np.flatnonzero(after > back)
            flat[stop[at] - 1 - back] = ends[end[at], back]
        edges = np.r_[0, stop[stops - 1]]
        out = [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        for i in np.flatnonzero(whole):
            out[i] = batch([texts[int(i)].as_py()])[0]
        return out

    held[vocabulary] = encode
    return encode


def write_token_shards(
    docs: DataFrame, folder: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 2,
    block: int = BLOCK, percentile: float = PERCENTILE, shards: int | None = None,
) -> DataFrame:
    """Encode all texts and write them in ascending id order to one file a shard in ``folder``.

    Returns the manifest (shard, uri, docs, ids), in shard order by number.
    Null texts are empty; null ids come first; rows of equal id are all
    written, ordered by a hash of the text.  A task writes under a name of its
    own and then renames, so a second attempt only replaces equal bytes.  An
    empty table writes no file.
    """
    n = shards or reduce_rows(docs.sparkSession)
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(vocabulary)

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for piece in pieces(batches, "text", 8192, 4 << 20):
                for name, ids in zip(piece.column("id").to_pylist(), encode(piece.column("text"))):
                    yield name, np.concatenate([ids, tail])

        own = rows()
        first = next(own, None)
        if first is None:
            return

        def again() -> Iterator[tuple[int | None, np.ndarray]]:
            yield first
            yield from own

        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}.pfor"
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part = f"{uri}.{uuid.uuid4().hex}"
        count, total = write_shard(part, again(), block, percentile)
        store.move(fs.FileSystem.from_uri(part)[1], fs.FileSystem.from_uri(uri)[1])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "docs": [count], "ids": [total]})

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    dealt = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    return cut_lineage(dealt.select("id", "text").mapInArrow(write, "shard long, uri string, docs long, ids long"))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files.

    ``start`` counts all ids before the document over all shards.  The only
    global step runs over the manifest, which has one row a file.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist()):
                rows = Shard(uri).digests()
                while part := [x for _, x in zip(range(8192), rows)]:
                    name, start, count, crc = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name, pa.int64()), pa.array([s + before for s in start], pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("shard", "uri", before.alias("before"))
    spread = files.repartitionByRange(reduce_rows(manifest.sparkSession), "shard").select("uri", "before")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 2, folder: str | None = None) -> DataFrame:
    """Write the shards to ``folder`` (a new shared one if none is given) and read them back."""
    folder = folder or fresh_dir(docs.sparkSession, "tokens")
    out = read_token_shards(write_token_shards(docs, folder, vocabulary, doc_id, text, end_id))
    return out.withColumnRenamed("doc_id", doc_id)
