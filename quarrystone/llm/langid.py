"""Language identification by compression with per-language dictionaries.

A text is cut into pieces, each piece is compressed by Zstandard with every
language's raw-content dictionary, and the language whose sizes add up to the
least is chosen; case is folded first.  Where runner-up and winner are close the row is marked
``rejected``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, raw_texts
from quarrystone.operators.tables import cut_lineage, near

#: Bounds of what a model is fitted on: documents and dictionary bytes a language, and dictionary bytes of all languages.
DOCS_PER_LANG, DICT_BYTES, ALL_DICT_BYTES = 150, 96_000, 64 << 20
#: Stretches of a sampled text that is longer than its share, spread evenly over the whole of it.
STRETCHES = 4
#: Bytes that are compressed at once: short against the dictionary, so that it stays decisive in long texts.
PIECE = 2048
LEVEL = 6
#: Least share by which the runner-up has to be larger.
MIN_MARGIN = 0.02


def fit_dictionaries(
    docs: DataFrame, learn_from: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    docs_per_lang: int = DOCS_PER_LANG, dict_bytes: int = DICT_BYTES, all_dict_bytes: int = ALL_DICT_BYTES, seed: int = 7,
) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample of the rows where ``learn_from`` holds.

    For each language the ``docs_per_lang`` distinct (id, text) of least
    seeded hash are taken, each cut to an equal share of ``dict_bytes``;
    every language has a dictionary.  Where they would pass
    ``all_dict_bytes`` together, each gets an equal part of that, so it is
    the dictionaries that get smaller and no language that is left out.  Rows
    of null id, text or language teach nothing.
    """
    able = docs.where(F.expr(learn_from) & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    able = able.select(F.col(lang).alias("l"), F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)).alias("h"), F.col(text).alias("t"))
    kinds = cut_lineage(able.select("l", "h").distinct())
    n_langs = kinds.select("l").distinct().count()
    if not n_langs:
        return {}
    dict_bytes = min(dict_bytes, max(1, all_dict_bytes // n_langs))
    docs_per_lang = min(docs_per_lang, max(1, dict_bytes // 64))
    # hashes are uniform: those low enough that about four times as many stay as are taken go to the window, however large the language
    sizes = cut_lineage(kinds.groupBy("l").agg(F.count("*").alias("n")))
    low = kinds.join(near(sizes), "l").where(F.col("h").cast("double") / float(1 << 64) + 0.5 <= 4.0 * docs_per_lang / F.col("n"))
    chosen = low.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= docs_per_lang).select("l", "h", "r")
    share = max(1, dict_bytes // docs_per_lang)
    part = max(1, share // STRETCHES)
    spread = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring("t", F.floor(i * (F.length("t") - part) / (STRETCHES - 1)).cast("int") + 1, F.lit(part)))
    cut = F.when(F.length("t") <= share, F.col("t")).otherwise(F.array_join(spread, "\n"))
    # equal rows have equal stretches, so any of them serves; at most docs_per_lang stretches a language come to the driver
    picked = able.join(near(cut_lineage(chosen)), ["l", "h"]).groupBy("l", "r").agg(F.min(cut).alias("t"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in picked.collect():
        texts.setdefault(row.l, []).append((row.r, row.t))
    return {k: "\n".join(t for _, t in sorted(v)).lower().encode()[:dict_bytes] for k, v in sorted(texts.items())}


def _squeezers(model: dict[str, bytes], names: list[str], level: int) -> list:
    out = []
    for name in names:
        known = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return out


def _classify(model: dict[str, bytes], min_margin: float):
    names = sorted(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeezers = _squeezers(model, names, LEVEL)
        for piece in pieces(batches, "text"):
            out = []
            for raw in raw_texts(piece.column("text")):
                text = raw.decode("utf-8", "replace")
                if not names or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, True))
                    continue
                raw = text.lower().encode()
                parts = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
                sizes = sorted((sum(len(squeeze(p)) for p in parts), name) for squeeze, name in zip(squeezers, names))
                best, second = sizes[0], sizes[1] if len(sizes) > 1 else (2 * sizes[0][0], "")
                margin = 1 - best[0] / second[0]
                out.append((best[1], second[0] / (best[0] + second[0]), margin < min_margin))
            lang, score, unsure = zip(*out)
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify_languages(docs: DataFrame, model: dict[str, bytes], held_out: str, doc_id: str = "doc_id", text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of every row.

    ``score`` is the runner-up's share of the two least sizes, 0.5 to 1.
    Null texts, texts without a letter, and all texts under an empty model are
    ``und`` with score 0 and rejected.  A model of one language always answers
    it.  Equal sizes go to the first name.  Rows of null or repeated id are
    classified like any other; a letter is what str.isalpha takes for one;
    texts of any length are read whole, and an empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.expr(held_out).alias("held_out"), F.col(text).alias("text"))
    out = rows.mapInArrow(_classify(model, min_margin), "id long, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", doc_id)
