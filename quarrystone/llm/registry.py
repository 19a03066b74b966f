"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import conversations, decontaminate, langid, lines, mixing, quality, resample, secret_scan, simhash, substrings, tokens, toxicity, warc
from quarrystone.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

#: Rows that a model may learn from: crc32 of the id's decimal text does not leave 2 modulo 4.
LEARN = "doc_id IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2"
HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, true)"


def vocabulary() -> str:
    """Path of the public vocabulary that op7's contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 3-word shingles, links at 3 bits or fewer."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, units or names."""
    return decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def dictionary() -> frozenset[str]:
    """Whole words of four letters or more of a public vocabulary, about 30,000."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        known = json.load(file)["model"]["vocab"]
    return frozenset(w[:-4] for w in known if w.endswith("</w>") and len(w) >= 8 and w[:-4].isalpha())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in all documents, each with the forest's score and verdict."""
    words = dictionary()
    forest = secret_scan.fit_findings(secret_scan.findings_table(spark), words)
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), forest, words)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factorization-machine toxicity score of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), LEARN)
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by compression."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.fit_dictionaries(docs, LEARN), HELD_OUT)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without passages that a document of smaller id has."""
    return substrings.remove_repeated_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to shards and read back."""
    return tokens.token_round_trip(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that are equal to an earlier line, or one word from it."""
    return lines.repeated_lines(table(spark, sf_dir, "documents")).drop("row")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality facts and verdict of all documents; documents labelled of quality 1 are trusted."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of all documents."""
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all conversations after damage, their cheapest repair, and a digest of the repaired turns."""
    rows = table(spark, sf_dir, "conversations")
    solved, turns = conversations.repair_conversations(conversations.damage_rows(rows))
    found = solved.join(conversations.turn_digests(turns).withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight and score towards the benchmark's n-grams, and the rank of those drawn."""
    ranked = resample.resample_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to WARC files and read back."""
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_langid": op5_langid,
    "op6_substrings": op6_substrings,
    "op7_tokens": op7_tokens,
    "op8_lines": op8_lines,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_conversations": op11_conversations,
    "op12_resample": op12_resample,
    "op13_warc": op13_warc,
}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: What DuckDB computes by plainer means, where ids are unique; hashes and models of the other queries have no SQL.
SQL: dict[str, str] = {
    "op6_substrings": rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), x AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) a),
        g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13) a), f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
        c AS (SELECT DISTINCT g.doc_id, g.i + o.n AS i FROM g JOIN f ON g.k = f.k AND f.first < g.doc_id CROSS JOIN (SELECT unnest(range(0, 13)) AS n) o),
        r AS (SELECT x.doc_id, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN x.word END, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
        SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id""",
    "op8_lines": r"""WITH l AS (SELECT doc_id, i - 1 AS no, ls[i] AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS ls FROM documents) a) b),
        p AS (SELECT *, doc_id * 1000000 + no AS pos FROM l WHERE len(w) > 0), d AS (SELECT line, any_value(w) AS w, len(any_value(w)) AS n, min(pos) AS pos FROM p GROUP BY line),
        v AS (SELECT line, pos, n, i, array_to_string(list_concat(w[1 : i - 1], w[i + 1 :]), ' ') AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 5) a), whole AS (SELECT line, pos, n, array_to_string(w, ' ') AS rest FROM d WHERE n >= 5),
        near AS (SELECT line, min(other) AS other FROM (SELECT line, pos, min(pos) OVER (PARTITION BY n, i, rest) AS other FROM v UNION ALL SELECT v.line, v.pos, o.pos AS other FROM v JOIN whole o ON o.n = v.n - 1 AND o.rest = v.rest UNION ALL SELECT o.line, o.pos, v.pos AS other FROM v JOIN whole o ON o.n = v.n - 1 AND o.rest = v.rest) q WHERE other < pos GROUP BY line),
        out AS (SELECT p.doc_id, p.no, CASE WHEN d.pos < p.pos THEN d.pos ELSE near.other END AS kept, CASE WHEN d.pos < p.pos THEN 0 ELSE 1 END AS distance FROM p JOIN d ON p.line = d.line LEFT JOIN near ON p.line = near.line WHERE d.pos < p.pos OR near.other IS NOT NULL)
        SELECT doc_id, no AS line_no, kept // 1000000 AS kept_id, kept % 1000000 AS kept_line_no, distance FROM out""",
    "op13_warc": r"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT n, h, min(page_id) AS first FROM p GROUP BY n, h)
        SELECT p.page_id, cast(p.n AS bigint) AS payload_bytes, array_to_string([substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substring(p.h, cast(5 * (i // 4) + 1 AS int), 5) AS int) >> cast(15 - 5 * (i % 4) AS int)) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
            CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to FROM p JOIN f ON p.n = f.n AND p.h = f.h""",
    "op10_mixing": rf"""WITH d AS (SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS last, cast(len({_WORDS}) AS bigint) AS size, doc_id || ':' || md5(coalesce(text, '')) AS tag FROM documents),
        st AS (SELECT s, last, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY s, last), wt AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY last, s) - 1) % 3 + 1] AS weight FROM st),
        lv AS (SELECT *, 2 * source_size AS cap, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, last, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(weight) OVER (ORDER BY 2 * source_size / weight, last, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others, sum(source_size) OVER () AS total FROM wt),
        tg AS (SELECT s, last, source_size, least(cast(cap AS double), max((1.5 :: double * total - caps) / others) OVER () * weight) AS target FROM lv), wh AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM tg),
        cl AS (SELECT d.s, d.last, length(bin(d.size)) AS class, sum(d.size) AS words, any_value(w.target - w.whole * w.source_size) AS rest FROM d JOIN wh w ON d.s = w.s AND d.last = w.last WHERE d.size > 0 GROUP BY d.s, d.last, length(bin(d.size))),
        ch AS (SELECT s, last, class, words, greatest(0, least(1, max(level) OVER (PARTITION BY s, last) / (1 + class))) AS p, rest FROM (SELECT *, (rest - coalesce(sum(words) OVER (PARTITION BY s, last ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(words / (1.0 :: double + class)) OVER (PARTITION BY s, last ORDER BY class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM cl) a),
        lf AS (SELECT s, last, any_value(rest) - coalesce(sum(CASE WHEN p >= 1 THEN words END), 0) AS rest FROM ch GROUP BY s, last),
        rk AS (SELECT d.doc_id, d.s, d.last, d.size, c.p, CASE WHEN c.p > 0 AND c.p < 1 THEN u / (1 - u) / (c.p / (1 - c.p)) END AS q, d.tag FROM (SELECT *, (cast('0x' || substring(md5('17:' || tag), 1, 13) AS bigint) + 0.5 :: double) / 4503599627370496.0 :: double AS u FROM d) d LEFT JOIN ch c ON d.s = c.s AND d.last = c.last AND length(bin(d.size)) = c.class AND d.size > 0),
        cu AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY s, last, q IS NULL ORDER BY q, tag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS run FROM rk)
        SELECT cu.doc_id, cu.size, w.source_size, w.target, cast(copies * cu.size AS bigint) AS taken, copies FROM (SELECT cu.*, cast(CASE WHEN cu.size = 0 THEN 0 ELSE w.whole + CASE WHEN cu.p >= 1 OR cu.run - cu.size / 2.0 <= lf.rest THEN 1 ELSE 0 END END AS bigint) AS copies FROM cu JOIN wh w ON cu.s = w.s AND cu.last = w.last LEFT JOIN lf ON cu.s = lf.s AND cu.last = lf.last) cu JOIN wh w ON cu.s = w.s AND cu.last = w.last""",
}
