"""Leaks, spans, sketches and pages: queries whose operators need more than one SQL text, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators import intervals, leaks, pages, quantiles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leakage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with half or more of a benchmark item's runs of eight words; shorter items whole."""
    found = leaks.run_share(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.withColumn("share", F.round("share", 6))


def segment_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of five seconds within the span that each signup opens, for as many minutes as its value, over all users."""
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    second = F.floor(F.col("us") / 1000000)
    spans = events.where("event_type = 'signup'").select(F.col("event_id").alias("id"), second.alias("low"), (second + F.floor(F.col("value") * 60)).alias("high"))
    found = intervals.contained(spans, events.select(F.col("event_id").alias("segment"), second.alias("start"), (second + 5).alias("stop")))
    return found.groupBy(F.col("id").alias("pair")).agg(F.count("*").alias("events"), F.min("segment").alias("first_event"), F.max("segment").alias("last_event"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 95th and 99th percentile of the values of each type of event, exact and without a task that holds a type."""
    events = _table(spark, sf_dir, "events").select("event_type", "value")
    found = quantiles.exact_quantiles(events, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "n")


def ext_supplier_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of each nation with suppliers; each side is counted before they meet, so no pairs of the two are made."""
    suppliers = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.countDistinct("s_suppkey").alias("suppliers"))
    customers = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("customers"))
    return suppliers.join(customers, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("s_nationkey", "suppliers", F.coalesce("customers", F.lit(0).cast("long")).alias("customers"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page without navigation, links, scraps and what its site repeats."""
    return pages.clean_pages(_table(spark, sf_dir, "pages")).select("page_id", "kept", "dropped", F.md5("text").alias("text"))


# Terms that count as technical, in upper or lower case, and punctuation that separates words of a query.
TECH_TERMS = r"\b(?:ReAct|LangGraph|RAG|CoT|ToT|Agent|Tool|MCP|embedding|vector|prompt|token|LLM|fine-?tune|RLHF|hallucination|context|memory|planning|reflection)\b"
CJK_SIGNS = "，。？！、；：\"\"''（）《》【】"


def technical_terms(text: str) -> Column:
    """The different technical terms of a text in lower case, in the order in which they come first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){TECH_TERMS}"), F.lit(0)), lambda t: F.lower(t)))


def query_words(text: str) -> Column:
    """The different words of two characters or more, in the order in which they come first."""
    flat = F.translate(F.coalesce(text, F.lit("")), CJK_SIGNS, " " * len(CJK_SIGNS))
    return F.array_distinct(F.filter(F.split(flat, r"\s+"), lambda t: F.length(t) >= 2))


def tech_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = technical_terms("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(terms).cast("long").alias("terms"))


def dedup_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(technical_terms("text"), ",").alias("terms"))


def tokenize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(query_words("text"), " ").alias("tokens"))


def _chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, chunk) of 400 characters every 300."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 101, F.lit(0)) / 300).cast("int"))
    return docs.where("text IS NOT NULL").select("doc_id", "text", F.explode(starts).alias("chunk_no")).select("doc_id", "chunk_no", F.substring("text", F.col("chunk_no") * 300 + 1, F.lit(400)).alias("chunk"))


def doc_cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk table after its documents have changed: chunks of changed and deleted ones go, and only changed and new ones are cut again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 5 <> 0")
    new = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("New: "), "text")).otherwise(F.col("text")))
    known = _chunks(old).withColumn("cut", F.lit("before"))
    state = lambda df, name: df.select("doc_id", F.md5("text").alias(name))
    same = state(old, "a").join(state(new, "b"), "doc_id").where("a = b").select("doc_id")
    again = new.join(same, "doc_id", "left_anti")
    applied = known.join(same, "doc_id", "left_semi").unionByName(_chunks(again).withColumn("cut", F.lit("now")))
    return applied.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"), "cut")


def conflict_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's events say: an official one counts before others, then the newest; how it was settled is told."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", (F.get_json_object("props", "$.k").cast("long") % 25 == 0).alias("official"))
    official = F.coalesce("official", F.lit(False))
    found = events.groupBy("user_id").agg(
        F.max_by("event_type", F.struct(official, "us", "event_id")).alias("winner"), F.count_distinct("event_type").alias("values"),
        F.count_distinct(F.when(official, F.col("event_type"))).alias("official_values"),
    )
    how = F.when(F.col("values") == 1, "agreed").when(F.col("official_values") == 1, "official").when(F.col("official_values") > 1, "newest official").otherwise("newest")
    return found.select("user_id", "winner", how.alias("settled_by"))


def speaker_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a user's events between pauses of six hours; those that ask (a view) or last under half of the user's mean are the interviewer's."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), F.round("value", 2).alias("seconds"))
    rows = rows.withColumn("stop", F.col("start") + F.floor(F.col("seconds") * 1000000).cast("long"))
    own = Window.partitionBy("user_id").orderBy("start", "event_id")
    cut = (F.col("start") - F.lag("stop").over(own) > 21600000000).cast("int")
    grouped = rows.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("turn", F.sum("cut").over(own))
    turns = grouped.groupBy("user_id", "turn").agg(F.min("start").alias("first"), F.max("stop").alias("last"), F.round(F.sum("seconds"), 2).alias("seconds"), F.max((F.col("event_type") == "view").cast("int")).alias("asks"))
    mean = turns.groupBy("user_id").agg(F.avg("seconds").alias("mean"))
    told = turns.join(mean, "user_id").withColumn("speaker", F.when((F.col("asks") == 1) | (F.col("seconds") < 0.5 * F.col("mean")), "interviewer").otherwise("candidate"))
    return told.select("user_id", F.col("turn").cast("long").alias("turn"), "first", "last", "seconds", "speaker")


QUERIES = {f.__name__: f for f in (leakage_match, segment_containment, latency_percentiles, ext_supplier_customer, html_clean, tech_keywords, dedup_keywords, tokenize_query, doc_cdc_apply, conflict_resolve, speaker_heuristic)}


def _plain(raw: str) -> str:
    """DuckDB's text of a piece of HTML."""
    out = f"regexp_replace({raw}, '<[^>]*>', ' ', 'g')"
    for sign, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{sign}', '{text}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_BARE = "html"
for _part in ("script", "style", "head", "noscript"):
    _BARE = rf"regexp_replace({_BARE}, '(?is)<{_part}\b.*?</{_part}\s*>', ' ', 'g')"
_RUN = "array_to_string(w[i : i + l - 1], ' ')"
_FIRST_SEEN = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_TERMS = f"list_transform(regexp_extract_all(coalesce(text, ''), '(?i){TECH_TERMS}'), lambda t: lower(t))"
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[，。？！、；：\"''（）《》【】]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2)"
_CUT = "SELECT doc_id, i AS chunk_no, md5(substring(text, i * 300 + 1, 400)) AS chunk, cut FROM (SELECT *, unnest(range(0, greatest(length(text) - 101, 0) // 300 + 1)) AS i FROM n) q"
SQL = {
    "tech_keywords": f"SELECT doc_id, len(list_distinct({_TERMS})) AS terms FROM documents",
    "dedup_keywords": f"SELECT doc_id, array_to_string({_FIRST_SEEN.replace('{0}', 'l')}, ',') AS terms FROM (SELECT doc_id, {_TERMS} AS l FROM documents) q",
    "tokenize_query": f"SELECT conv_id, turn, array_to_string({_FIRST_SEEN.replace('{0}', 'l')}, ' ') AS tokens FROM (SELECT conv_id, turn, {_TOKENS} AS l FROM conversations) q",
    "doc_cdc_apply": f"WITH n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'New: ' || text ELSE text END AS text, CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 <> 0 THEN 'before' ELSE 'now' END AS cut FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL) {_CUT}",
    "conflict_resolve": """WITH e AS (SELECT user_id, event_type, ts, event_id, coalesce(cast(json_extract_string(props, '$.k') AS bigint) % 25 = 0, false) AS o FROM events), w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY o DESC, ts DESC, event_id DESC) AS r FROM e),
        c AS (SELECT user_id, count(DISTINCT event_type) AS v, count(DISTINCT CASE WHEN o THEN event_type END) AS ov FROM e GROUP BY user_id) SELECT c.user_id, w.event_type AS winner, CASE WHEN v = 1 THEN 'agreed' WHEN ov = 1 THEN 'official' WHEN ov > 1 THEN 'newest official' ELSE 'newest' END AS settled_by FROM c JOIN w ON w.user_id = c.user_id AND w.r = 1""",
    "speaker_heuristic": """WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS a, round(value, 2) AS s, epoch_us(ts) + cast(floor(round(value, 2) * 1000000) AS bigint) AS b FROM events), g AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a, event_id) > 21600000000 THEN 1 ELSE 0 END AS c FROM e),
        t AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM g), u AS (SELECT user_id, turn, min(a) AS first, max(b) AS last, round(sum(s), 2) AS seconds, bool_or(event_type = 'view') AS asks FROM t GROUP BY user_id, turn)
        SELECT user_id, cast(turn AS bigint) AS turn, first, last, seconds, CASE WHEN asks OR seconds < 0.5 * avg(seconds) OVER (PARTITION BY user_id) THEN 'interviewer' ELSE 'candidate' END AS speaker FROM u""",
    "leakage_match": rf"""WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark), il AS (SELECT *, least(8, len(w)) AS l FROM iw WHERE len(w) > 0), ir AS (SELECT DISTINCT item_id, l, {_RUN} AS run FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM il) a),
        n AS (SELECT item_id, count(*) AS n FROM ir GROUP BY item_id), dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), dr AS (SELECT DISTINCT doc_id, l, {_RUN} AS run FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT l FROM il) l WHERE len(w) >= l) b)
        SELECT dr.doc_id, ir.item_id, round(count(*) / max(n.n), 6) AS share FROM dr JOIN ir ON dr.run = ir.run AND dr.l = ir.l JOIN n ON n.item_id = ir.item_id GROUP BY dr.doc_id, ir.item_id HAVING count(*) / max(n.n) >= 0.5""",
    "segment_containment": "WITH s AS (SELECT event_id, event_type, value, epoch_us(ts) // 1000000 AS s FROM events) SELECT p.event_id AS pair, count(*) AS events, min(e.event_id) AS first_event, max(e.event_id) AS last_event FROM s p JOIN s e ON e.s >= p.s AND e.s + 5 <= p.s + cast(floor(p.value * 60) AS bigint) WHERE p.event_type = 'signup' GROUP BY p.event_id",
    "html_clean": rf"""WITH b AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_split_to_array(regexp_replace({_BARE}, '(?is)<!--.*?-->|<!doctype[^>]*>', ' ', 'g'), '(?i)</?(?:p|div|article|section|nav|header|footer|aside|main|ul|ol|li|table|tr|td|th|h[1-6]|body|html|form|blockquote|pre|br)\b[^>]*>') AS raws FROM pages),
        r AS (SELECT page_id, host, i, raws[i] AS raw FROM (SELECT *, unnest(range(1, len(raws) + 1)) AS i FROM b) x), t AS (SELECT page_id, host, i, {_plain('raw')} AS text, {_plain("array_to_string(regexp_extract_all(raw, '(?is)<a[^>]*>(.*?)</a>', 1), ' ')")} AS linked FROM r),
        c AS (SELECT host, text, count(DISTINCT page_id) AS pages FROM t WHERE text <> '' GROUP BY host, text), k AS (SELECT t.*, length(linked) / length(t.text) <= 0.5 AND len(string_split(t.text, ' ')) >= 3 AND c.pages < 3 AS keep FROM t JOIN c ON c.host = t.host AND c.text = t.text)
        SELECT p.page_id, count(CASE WHEN k.keep THEN 1 END) AS kept, count(CASE WHEN NOT k.keep THEN 1 END) AS dropped, md5(coalesce(string_agg(CASE WHEN k.keep THEN k.text END, E'\n' ORDER BY k.i), '')) AS text FROM pages p LEFT JOIN k ON k.page_id = p.page_id GROUP BY p.page_id""",
}
