"""Chunkers whose packing is sequential: recursive, structure-aware and by syntax tree."""

from __future__ import annotations

import ast
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？\n]*\s*|[.!?。！？\n]+\s*")


def pack_recursive(text: str, size: int = 512, marks: tuple[str, ...] = ("\n\n", "\n", "。", " ")) -> list[str]:
    """Pieces of at most ``size`` characters that concatenate to the text: split at the first mark that helps, then packed greedily."""
    if len(text) <= size:
        return [text] if text else []
    for i, mark in enumerate(marks):
        if mark in text:
            parts = [p + mark for p in text.split(mark)]
            parts[-1] = parts[-1][: -len(mark)]
            out: list[str] = []
            for part in (q for p in parts for q in pack_recursive(p, size, marks[i + 1 :])):
                if out and len(out[-1]) + len(part) <= size:
                    out[-1] += part
                else:
                    out.append(part)
            return out
    return [text[i : i + size] for i in range(0, len(text), size)]


def split_structured(text: str, size: int = 800) -> list[str]:
    """Fenced code stays whole; a table longer than ``size`` is split with its header lines repeated."""
    blocks, kind, held = [], "", []
    for line in text.split("\n"):
        fence = line.startswith("```")
        now = "code" if kind == "code" and not fence else "code" if fence and kind != "code" else "table" if line.startswith("|") else "text"
        closing = fence and kind == "code"
        if held and not closing and now != kind:
            blocks.append((kind, held))
            held = []
        held.append(line)
        kind = now
        if closing:
            blocks.append(("code", held))
            held, kind = [], ""
    if held:
        blocks.append((kind, held))
    out = []
    for kind, lines in blocks:
        body = "\n".join(lines)
        if kind != "table" or len(body) <= size:
            out += [body] if kind != "text" else pack_recursive(body, size)
            continue
        head, rows = lines[:2], lines[2:]
        part: list[str] = []
        for row in rows:
            if part and len("\n".join([*head, *part, row])) > size:
                out.append("\n".join([*head, *part]))
                part = []
            part.append(row)
        out.append("\n".join([*head, *part]))
    return out


def split_python(text: str) -> list[str]:
    """Top-level functions and classes of Python source; source that does not parse is one chunk."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [text] if text else []
    return [ast.get_source_segment(text, n) or "" for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]


def chunk(docs: DataFrame, splitter: Callable[[str], list[str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, chunk) by any splitter of one text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, parts = [], [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = splitter(body or "")
                ids += [name] * len(own)
                numbers += range(len(own))
                parts += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.string())], ["doc_id", "chunk_no", "chunk"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, chunk_no int, chunk string")


def title_paths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line, path): each line of Markdown with the headings above it, joined by ' > '."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,3}) ", 1))
    lines = lines.withColumn("level", level).withColumn("title", F.regexp_extract("line", r"^#{1,3} +(.*)$", 1))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    spot = [F.max(F.when(F.col("level") == n, F.col("line_no"))).over(upto).alias(f"p{n}") for n in (1, 2, 3)]
    last = [F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(upto).alias(f"h{n}") for n in (1, 2, 3)]
    lines = lines.select("doc_id", "line_no", "line", *spot, *last)
    # a heading counts only if no shallower one has begun since
    h2 = F.when(F.col("p2") > F.coalesce("p1", F.lit(-1)), F.col("h2"))
    h3 = F.when(F.col("p3") > F.greatest(F.coalesce("p1", F.lit(-1)), F.coalesce("p2", F.lit(-1))), F.col("h3"))
    return lines.select("doc_id", "line_no", "line", F.concat_ws(" > ", "h1", h2, h3).alias("path"))


# Labels of the two sides of an interview.
_ASKS, _ANSWERS = "面试官|Q|Interviewer", "候选人|A|Candidate"


def labelled_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pair, question, answer) of texts whose parts begin with a role label, numbered from 1.

    An answer belongs to the question before it, which it closes; a question
    that another follows is lost, and so is an answer without one.
    """
    label = rf"(?i)(?=(?:{_ASKS}|{_ANSWERS})[：:])"
    parts = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, label)).alias("no", "part"))
    for name, own in (("asks", _ASKS), ("answers", _ANSWERS)):
        parts = parts.withColumn(name, F.regexp_extract("part", rf"(?is)^(?:{own})[：:]\s*(.*)$", 1)).withColumn(f"is_{name}", F.col("part").rlike(rf"(?i)^(?:{own})[：:]"))
    # an answer stands right after its question, once parts of neither kind and empty questions are left out
    said = parts.where("(is_asks AND trim(asks) <> '') OR is_answers").withColumn("asked", F.lag(F.when(F.col("is_asks"), F.col("asks"))).over(Window.partitionBy("doc_id").orderBy("no")))
    pairs = said.where("is_answers AND NOT is_asks AND asked IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("no"))
    clean = lambda c: F.trim(F.col(c), F.lit(" \t\r\n"))
    return pairs.select("doc_id", number.alias("pair"), clean("asked").alias("question"), clean("answers").alias("answer"))


def semantic_chunks(
    docs: DataFrame, encoder: Callable[[list[str]], list[list[float]]], doc_id: str = "doc_id", text: str = "text", least: float = 0.5, size: int = 512,
) -> DataFrame:
    """(doc_id, chunk_no, chunk): sentences joined while neighbours' vectors have a cosine of ``least`` or more; longer chunks are split again.

    ``encoder`` gives a vector for each sentence; a text's sentences go to it
    together.
    """

    def split(body: str) -> list[str]:
        sentences = [x for x in _SENTENCE.findall(body) if x.strip()]
        if not sentences:
            return []
        vectors = np.asarray(encoder(sentences), np.float64)
        lengths = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        near = (vectors[1:] * vectors[:-1]).sum(1) / (lengths[1:] * lengths[:-1]) >= least
        parts = [sentences[0]]
        for sentence, joined in zip(sentences[1:], near):
            if joined:
                parts[-1] += sentence
            else:
                parts.append(sentence)
        return [piece for part in parts for piece in pack_recursive(part, size)]

    return chunk(docs, split, doc_id, text)


def hashed_encoder(sentences: list[str], size: int = 64) -> list[list[float]]:
    """Counts of hashed words: a deterministic stand-in for a model."""
    out = np.zeros((len(sentences), size))
    for row, sentence in enumerate(sentences):
        for word in re.findall(r"\w+", sentence.lower()):
            out[row, zlib.crc32(word.encode()) % size] += 1
    return out.tolist()
