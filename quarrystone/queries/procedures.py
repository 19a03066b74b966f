"""Queries that one SQL text does not express: recursion over values, folds, graphs, near-copies, streams and plug-ins.

``SQL`` holds what DuckDB computes for them by other means, written apart from
the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quarrystone.functions import columns
from quarrystone.operators import chunks, messages, nearest, rates, similar
from quarrystone.operators.components import connected_components
from quarrystone.operators.tables import fresh_dir
from quarrystone.plans import graph, tools, walks
from quarrystone.queries import dialect, graphs
from quarrystone.sources import files
from quarrystone.sources.merge_table import MergeTable
from quarrystone.streaming import assemble


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- messages and tools

#: Arguments of one call for each event, right and wrong in turn.
_ARGUMENTS = "CASE event_id % 8 WHEN 0 THEN '{\"city\": ' WHEN 1 THEN '[1]' WHEN 2 THEN '{}' WHEN 3 THEN '{\"city\": 5}' WHEN 4 THEN '{\"city\": \"  \"}' WHEN 5 THEN '{\"city\": null}' ELSE concat('{\"city\": \"', event_type, '\"}') END"
_ERROR = "CASE event_id % 8 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'arguments_must_be_object' WHEN 2 THEN 'missing_required' WHEN 3 THEN 'invalid_type' WHEN 4 THEN 'empty_required' WHEN 5 THEN 'invalid_type' END"


#: A call for each event, by turns of a tool's name and of its arguments.
_TOOL = "CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'nation' WHEN 2 THEN NULL ELSE 'segment' END"
_SEGMENT = "CASE user_id % 6 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' WHEN 4 THEN 'MACHINERY' ELSE 'NO SUCH' END"
_CALL = f"CASE event_id % 7 WHEN 0 THEN '{{\"segment\": ' WHEN 1 THEN '[1]' WHEN 2 THEN '{{}}' WHEN 3 THEN '{{\"segment\": 5, \"nation\": \"1\"}}' WHEN 4 THEN '{{\"segment\": \" \", \"nation\": \"1\"}}' ELSE concat('{{\"nation\": \"', user_id % 30, '\", \"segment\": \"', {_SEGMENT}, '\"}}') END"


def redact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.lit("Bearer abc.def").alias("authorization"), F.lit("p").alias("Passwd"), F.lit("t").alias("x_auth_token"), F.col("event_id").alias("n"))
    payload = F.to_json(F.struct("event_type", inner.alias("headers"), F.concat(F.lit("api key: "), F.col("user_id"), F.lit(" ok")).alias("note")))
    return _table(spark, sf_dir, "events").select("event_id", messages.redact_json(payload).alias("payload"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat('user ', user_id, ' BEARER ', md5(props), ', Api Key = ', event_type, '; sk-', substring(md5(event_type), 1, 12), ' password:x, sk-short')")
    return _table(spark, sf_dir, "events").select("event_id", messages.redact_plain(line).alias("line"))


def json_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])).alias("log"))
    return turns.select("conv_id", messages.compress_json(F.col("log")).alias("log"))


def validate_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.expr(_ARGUMENTS).alias("a")).select("event_id", columns.argument_error(F.col("a"), ["city"]).alias("error"))


def action_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE WHEN event_id % 10 = 0 THEN '  not { json ' ELSE concat('{\"c\": \"x  y\", \"b\": [1, 2 ],\"a\": ', props, ' }') END")
    return _table(spark, sf_dir, "events").select("event_id", columns.action_fingerprint(F.col("event_type"), raw).alias("fp"))


def tool_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of two tools over the customers, of one that does not exist, and with wrong arguments."""
    people = _table(spark, sf_dir, "customer")
    segments = people.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"), F.round(F.max("c_acctbal"), 2).alias("richest"))
    nations = people.groupBy(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))
    known = [tools.TableTool("segment", "Customers of a market segment", ("segment",), segments), tools.TableTool("nation", "Customers of a nation in a segment", ("nation", "segment"), nations)]
    calls = _table(spark, sf_dir, "events").select("event_id", F.expr(_TOOL).alias("tool"), F.expr(_CALL).alias("arguments"))
    return tools.call_tools(calls, known).select("event_id", "result.ok", "result.data", "result.error")


def provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    def answer(texts: list[str]) -> list[str]:
        if any(t.startswith("error") for t in texts):
            raise TimeoutError("no answer")
        return [t[::-1] for t in texts]

    asked = tools.Provider(answer, limit=1, retries=1).over(F.concat("event_type", F.lit("-"), "event_id"))
    return _table(spark, sf_dir, "events").select("event_id", asked.alias("r")).select("event_id", "r.value", "r.error", "r.attempts")


def embed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = tools.embed_batch(rows, "source", "text", lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts])
    return out.select("doc_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("a"))


def hook_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [
        tools.Hook(20, inputs={"value": F.col("value") + 1}),
        tools.Hook(10, block=F.when(F.col("event_type") == "error", "no errors"), skip=F.col("event_type") == "view"),
        tools.Hook(30, block=F.when(F.col("value") > 100, "too large"), results={"double": F.round("double", 3)}),
    ]
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return tools.with_hooks(rows, lambda df: df.withColumn("double", F.col("value") * 2), chain).withColumn("value", F.round("value", 3))


def subagent(spark: SparkSession, sf_dir: str) -> DataFrame:
    def worker(row: dict) -> dict:
        if row["event_type"] == "error":
            raise ValueError("cannot")
        count = (row["state"] or 0) + 1
        return {"state": count, "done": count >= row["k"], "visits": count}

    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 9).alias("k"), "props")
    return tools.subagent(rows, "event_id", worker, ["event_type", "k"], "visits long").select("event_id", "status", "steps", "error", "visits")


def skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = graph.Registry().register("clean", lambda df: df.withColumn("body", F.lower(F.trim("text")))).register("measure", lambda df: df.withColumn("chars", F.length("body").cast("long")))
    registry.register("grade", lambda df: df.withColumn("grade", F.when(F.col("chars") > 1000, "long").otherwise("short")))
    return registry.run(_table(spark, sf_dir, "documents"), "clean", "measure", "grade").select("doc_id", "chars", "grade")


def state_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    short, english = F.col("n_chars") < 200, F.col("lang") == "en"
    plan = graph.StateGraph().node("read", steps=F.lit("read")).node("upper", state=columns.upper_letters("state"), steps=F.concat("steps", F.lit(">upper"))).node("lower", state=columns.lower_letters("state"), steps=F.concat("steps", F.lit(">lower")))
    plan.node("end", steps=F.concat("steps", F.lit(">end"))).edge("read", "upper", short).edge("read", "lower", ~short & english).edge("read", "end", ~short & ~english).edge("upper", "end").edge("lower", "end")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", F.col("text").alias("state"))
    return plan.compile("read")(rows).select("doc_id", "steps", F.md5("state").alias("state"))


def loop_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"), F.lit(0).alias("rounds"))
    step = lambda df: df.withColumn("rounds", F.col("rounds") + (F.col("size") > 100).cast("int")).withColumn("size", F.when(F.col("size") > 100, F.floor(F.col("size") / 2)).otherwise(F.col("size")))
    return graph.loop_until(rows, step, lambda df: df.where("size > 100").isEmpty(), 40)


def reducer_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("role", "s").alias("parts"))
    return rows.groupBy("conv_id").agg(F.array_join(columns.add_lists(F.col("parts"), F.col("turn")), ",").alias("parts"))


@udtf(returnType="line_no long, line string")
class LineTable:
    def eval(self, text: str):
        for number, line in enumerate((text or "").split("\n")):
            if line:
                yield number, line


def splitter_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("text_lines", LineTable)
    _table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations_for_lines")
    return spark.sql("SELECT c.conv_id, c.turn, l.line_no, l.line FROM conversations_for_lines c, LATERAL text_lines(c.text) l")


# --- files

#: Markdown with two questions a document, the second without an expert answer.
_MARKDOWN = "concat('# notes\\n## other\\n## Q: of ', doc_id, '\\n> 来源: ', source, '\\n**新手答**: \"plain ', lang, '\"\\n\\n**高手答**:\\nfirst ', n_chars, '\\nsecond\\n\\n**差距在哪**: depth\\n\\n---\\n### Q：again\\n**新手答**: x\\n')"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.expr("concat('/kb/d', doc_id, '.md')").alias("path"), F.expr(_MARKDOWN).alias("content"))


def parse_md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.question_sections(_markdown(spark, sf_dir)).select("path", "index", F.length("section").cast("long").alias("chars"))


def parse_md_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.question_fields(files.question_sections(_markdown(spark, sf_dir)))


def scan_md_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "markdown")
    for name, text in (("a", "## Q: one\n**高手答**:\nyes\n**差距在哪**: g\n"), ("b", "## Q: two\n**高手答**:\nno\n**考察点**: h\n### Q: three\n"), ("c", "## Q: unlisted\n**高手答**:\nno\n**考察点**: h\n")):
        files.write_file(spark, f"{folder}/{name}.md", text)
    return files.read_questions(spark, folder, {"a": "First", "b": "Second"}).select("id", "question", "expert_answer", "gap", "dimension_label")


def scan_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.expr("concat('---\\nname: s', doc_id, '\\ndescription: about ', lang, ': more\\n---\\nbody ', n_chars)")
    return files.front_matter(_table(spark, sf_dir, "documents").select(F.expr("concat('/s/', doc_id, '/SKILL.md')").alias("path"), content.alias("content")))


def scan_json_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "tasks")
    for i in range(3):
        files.write_file(spark, f"{folder}/task_{i}.json", f'{{"id": {i},\n "subject": "t{i}", "blockedBy": [{i - 1}]}}')
    return files.read_json_dir(spark, folder, "id long, subject string, blockedBy array<long>").select("id", "subject", F.col("blockedBy")[0].alias("blocker"))


def write_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "note") + "/note.txt"
    size = files.write_file(spark, path, "first\nsecond é")
    return spark.read.text(path).select(F.lit(size).alias("bytes"), "value")


def list_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.list_dir(spark, sf_dir, "*.parquet").select("path", "size")


def sink_trace_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = files.Trace(spark, fresh_dir(spark, "trace"))
    rows = _table(spark, sf_dir, "events").select("event_id", F.lit("s3cret").alias("password"), F.concat(F.lit("Bearer "), "event_type").alias("header"))
    trace.record(rows, "tool_result")
    return spark.read.text(trace.path)


def sink_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "report")
    files.write_report(_table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), path)
    return spark.read.schema("lang string, n long").json(path)


def sse_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.server_events(_table(spark, sf_dir, "events").select("event_id", "event_type"), "progress", ["event_id"])


def cdc_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of changes, the second with old and repeated records, through a stream into a table."""
    folder = fresh_dir(spark, "cdc")
    changes = _table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "user_id", F.col("event_id").alias("position"), "event_type")
    table = MergeTable(spark, f"{folder}/table", "user_id", "position")
    for part in ("position % 3 > 0", "position % 2 = 0"):
        changes.where(part).coalesce(2).write.mode("append").parquet(f"{folder}/log")
        table.follow(spark.readStream.schema(changes.schema).parquet(f"{folder}/log"), f"{folder}/checkpoint").awaitTermination()
    return table.read()


def _knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, MergeTable]:
    """Documents, and a table that holds them after two batches: all of them, and changes, deletes and new ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")
    first = docs.select(F.lit("upsert").alias("op"), "doc_id", F.lit(0).cast("long").alias("position"), "lang", "n_chars")
    turn = F.col("doc_id") % 10
    second = first.where(turn.isin(3, 7, 4)).withColumn("position", F.lit(1).cast("long")).withColumn("op", F.when(turn == 7, "delete").otherwise("upsert"))
    second = second.withColumn("lang", F.when(turn == 3, "xx").otherwise(F.col("lang"))).withColumn("doc_id", F.col("doc_id") + F.when(turn == 4, 1000000000).otherwise(0))
    table = MergeTable(spark, fresh_dir(spark, "knowledge"), "doc_id", "position")
    table.apply(first, 0)
    table.apply(second, 1)
    table.apply(second.withColumn("lang", F.lit("never")), 1)  # told twice
    return docs, table


def sink_kb_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by key after changed, deleted and new ones, read from base and delta files."""
    _, table = _knowledge(spark, sf_dir)
    table.compact()
    return table.read().select("doc_id", "lang")


def ext_missed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would make the table equal to the documents again."""
    docs, table = _knowledge(spark, sf_dir)
    return files.missed_changes(docs, table.read().drop("position"), "doc_id")


def synthetic_sql_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nation", "region")
    for t in names:
        _table(spark, sf_dir, t).createOrReplaceTempView(f"{t}_made")
    texts = {
        "one": "SELECT n_name FROM nation_made WHERE n_regionkey = 1", "all": "SELECT * FROM nation_made", "none": "SELECT * FROM region_made WHERE r_regionkey < 0",
        "bad": "SELECT nothing FROM nation_made", "syntax": "SELEC 1", "count": "SELECT count(*) FROM region_made",
    }
    found = files.working_queries(spark, texts, {f"{t}_made": _table(spark, sf_dir, t).count() for t in names})
    return spark.createDataFrame(sorted(found.items()), "query string, status string")


# --- chunks

def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(_table(spark, sf_dir, "documents"), chunks.pack_recursive)


def chunk_structure_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(_table(spark, sf_dir, "documents"), chunks.split_structured)


def chunk_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(_table(spark, sf_dir, "documents"), chunks.split_python)


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.semantic_chunks(_table(spark, sf_dir, "documents"), chunks.hashed_encoder, least=0.3)


def split_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("role") == "user", "Interviewer: ").otherwise("Candidate：")
    said = F.concat(label, F.translate("text", ":：", "  "), F.lit("\n"))
    talks = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), "").alias("text"))
    out = chunks.labelled_pairs(talks, "conv_id")
    return out.select(F.col("doc_id").alias("conv_id"), "pair", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


def title_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.expr("concat('# D', doc_id, '\\n', substring(lang, 1, 1), '\\n## A\\nx\\n### B\\ny\\n## C\\nz\\n# E\\n### F\\nw')")
    return chunks.title_paths(_table(spark, sf_dir, "documents").select("doc_id", heads.alias("text")))


def listing_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, a listing of its documents in order: an entry that would pass 8,000 characters shows its name only.

    The listing passes its budget within its first 1,000 entries, as each has
    8 characters or more; what follows is names, so only those are folded.
    """
    name = F.concat(F.lit("- **"), F.col("doc_id").cast("string"), F.lit("**"))
    described = F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(252))
    rows = _table(spark, sf_dir, "documents").select("source", "doc_id", F.length(name).alias("short"), (F.length(name) + 2 + described).alias("full"))
    ranked = similar.top_scored(rows.withColumn("minus", -F.col("doc_id")), "source", "doc_id", "minus", 1000).drop("rank", "minus")
    folded = ranked.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "short", "full"))).alias("rows"))
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<boolean>").alias("shown"))

    def add(state, row):
        fits = state["total"] + row["full"] <= 8000
        return F.struct((state["total"] + F.when(fits, row["full"]).otherwise(row["short"])).alias("total"), F.concat(state["shown"], F.array(fits)).alias("shown"))

    shown = folded.select("source", F.explode(F.arrays_zip(F.transform("rows", lambda r: r["doc_id"]).alias("doc_id"), F.aggregate("rows", start, add)["shown"].alias("shown"))).alias("e"))
    first = shown.select("source", F.col("e.doc_id").alias("doc_id"), F.col("e.shown").alias("full_text"))
    return rows.select("source", "doc_id").join(first, ["source", "doc_id"], "left").withColumn("full_text", F.coalesce("full_text", F.lit(False)))


# --- rates

def _admit(rule, result: str = "allowed boolean"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        timed = _table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        out = rates.admit(timed, rule, "user_id", "us", "event_id", result)
        return out.withColumn("wait_s", F.round("wait_s", 2)) if result.startswith("wait") else out

    return run


# --- near-copies and ranks

def dedup_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.minhash_classes(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def dedup_simhash_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("chunk"))
    return similar.simhash_chunks(lines, "chunk")


def dedup_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct vectors above 0.95, among the table and a slightly moved copy of every fifth vector."""
    links, _ = similar.cosine_links(_moved(spark, sf_dir), "id", "v", 0.95)
    return links.select("a", "b", F.round("score", 4).alias("score"))


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return vectors.unionByName(vectors.where("id % 5 = 0").select((F.col("id") + 1000000000).alias("id"), F.transform("v", lambda x, i: x + F.when(i % 7 == 0, 0.05).otherwise(0.0)).alias("v")))


def memory_semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = similar.cosine_classes(_moved(spark, sf_dir), "id", "v", 0.85)
    return classes.groupBy("class_id").agg(F.count("*").alias("confidence"), F.max("id").alias("newest"))


def dedup_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DBSCAN classes, of each the row of best quality; rows that are noise stay by themselves."""
    found = similar.dbscan(_moved(spark, sf_dir), "id", "v", 0.85, 3)
    classes = found.select("id", F.coalesce("class_id", "id").alias("class_id"))
    best = similar.best_of_class(classes, classes.select("id", (F.col("id") % 1000003 % 101).cast("double").alias("quality")))
    return best.join(found.select("id", "kind"), "id").select("class_id", "id", "size", "kind")


def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL")
    q = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    near = nearest.top_scores(q, vectors.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), 20, rounded=False).withColumnRenamed("id", "vec_id")
    top = similar.top_scored(near, "qid", "vec_id", "score", 20).join(vectors.select("vec_id", "embedding"), "vec_id")
    return similar.mmr(top, "qid", "vec_id", "score", "embedding")


# --- walks and streams

def topo_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = "array(struct(cast(floor(event_id / 3) AS bigint) AS u, event_id AS v), struct(cast(floor(event_id / 4) AS bigint) AS u, event_id AS v))"
    edges = _table(spark, sf_dir, "events").where("event_id > 0").select(F.inline(F.expr(pairs)))
    cycle = spark.createDataFrame([(-1, -2), (-2, -1), (-2, -3), (0, -3)], "u long, v long")
    return walks.waves(edges.unionByName(cycle), "u", "v")


def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id > 0 THEN cast(floor(event_id / 3) AS bigint) END").alias("caused_by"))
    return walks.chain_lengths(links, "event_id", "caused_by").select(F.col("node").alias("event_id"), F.col("length").alias("chain"))


def call_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id > 0 THEN cast(floor(event_id / 3) AS bigint) END").alias("parent"), (F.col("user_id") % 40).alias("agent"))
    return walks.repeated_callers(calls, "event_id", "parent", "agent").withColumnRenamed("call", "event_id")


def knowledge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples (user, asks, topic) merged with their support, and the community of each, over triples of support 2 or more."""
    triples = _table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("s"), F.concat(F.lit("t"), F.col("user_id") % 30, F.lit("-"), F.get_json_object("props", "$.k").cast("long") % 5).alias("o"))
    merged = triples.groupBy("s", "o").agg(F.count("*").alias("support")).where("support >= 2")
    roots = connected_components(merged, "s", "o")
    return merged.join(roots.withColumnRenamed("node", "s"), "s", "left").select("s", "o", "support", F.coalesce("root", "s").alias("community"))


def stream_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assemble(spark.sql(dialect.spark_sql(f"WITH {graphs.STREAM} SELECT stream_id, seq, kind, call_id, delta FROM deltas")))


def stream_parse_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each event: a text, and a call whose arguments come in two parts, or none for errors."""
    whole = "CASE WHEN event_type <> 'error' THEN props END"
    half = "CAST(length(props) / 2 AS int)"
    steps = [
        ("text_delta", "NULL", "NULL", "event_type", "0"), ("tool_use_start", "concat('c', event_id)", "'look'", "NULL", "0"), ("tool_use_delta", "NULL", "NULL", f"substring({whole}, 1, {half})", "0"),
        ("tool_use_delta", "NULL", "NULL", f"substring({whole}, {half} + 1)", "0"), ("tool_use_end", "NULL", "NULL", "NULL", "0"), ("message_end", "NULL", "NULL", "'tool_use'", "event_id"),
    ]
    one = "named_struct('seq', {}, 'type', '{}', 'id', cast({} AS string), 'name', cast({} AS string), 'body', cast({} AS string), 'tokens', cast({} AS bigint))"
    parts = f"array({', '.join(one.format(i, *step) for i, step in enumerate(steps))})"
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("stream_id"), F.inline(F.expr(parts)))
    return assemble.parse_gateway(rows)


QUERIES = {
    **{f.__name__: f for f in (
        redact_keys, redact_text, json_compress, validate_args, action_fingerprint, tool_spec, provider, embed_batch, hook_pipeline, subagent, skill, state_graph, loop_until, reducer_udaf, splitter_udtf,
        parse_md_sections, parse_md_fields, scan_md_qa, scan_frontmatter, scan_json_dir, write_file, list_dir, sink_trace_jsonl, sink_report_file, sse_sink, cdc_sync, sink_kb_upsert, ext_missed_changes, synthetic_sql_filter,
        chunk_recursive, chunk_structure_aware, chunk_ast, chunk_semantic, split_labeled, title_path, listing_budget, dedup_minhash, dedup_simhash_chunk, dedup_cosine, memory_semantic_merge, dedup_semantic, mmr,
        topo_waves, causal_chain, call_cycle, knowledge_graph, stream_assemble, stream_parse_gateway,
    )},
    "rate_sliding": _admit(rates.sliding(3, 86400.0)),
    "rate_token_bucket": _admit(rates.token_bucket(3.0, 1 / 43200)),
    "rate_leaky": _admit(rates.leaky_bucket(3.0, 1 / 43200)),
    "token_bucket": _admit(rates.bucket_waits(3.0, 1 / 43200), "wait_s double"),
}

_TIMED = "ev AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events)"


def _fold(state: str, first: str, columns: str, result: str) -> str:
    """A fold of each user's events, one event a step: ``state`` from r and e, in DuckDB."""
    return f"WITH RECURSIVE {_TIMED}, r AS (SELECT user_id, event_id, n, us, {first} FROM ev WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.us, {state} FROM (SELECT ev.user_id, ev.event_id, ev.n, ev.us, {columns} FROM r JOIN ev ON ev.user_id = r.user_id AND ev.n = r.n + 1) e) SELECT user_id, event_id, {result} FROM r"


_MOVED = "v AS (SELECT vec_id AS id, cast(embedding AS double[]) AS v FROM embeddings UNION ALL SELECT vec_id + 1000000000 AS id, list_transform(cast(embedding AS double[]), lambda x, i: x + CASE WHEN (i - 1) % 7 = 0 THEN 0.05 ELSE 0 END) AS v FROM embeddings WHERE vec_id % 5 = 0), b AS (SELECT min(id) AS id, v FROM v GROUP BY v)"
_COSINE = "list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v))"
_CLASSES = f"{_MOVED}, l AS (SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON x.id <> y.id WHERE {_COSINE} > 0.85), reach AS (SELECT id AS a, id AS b FROM b UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), c AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a), cl AS (SELECT v.id, c.class_id FROM v JOIN b ON v.v = b.v JOIN c ON c.rep = b.id)"

SQL = {
    "redact_keys": """SELECT event_id, '{"event_type":"' || event_type || '","headers":{"authorization":"[REDACTED]","Passwd":"[REDACTED]","x_auth_token":"[REDACTED]","n":' || event_id || '},"note":"api key=[REDACTED] ok"}' AS payload FROM events""",
    "redact_text": "SELECT event_id, 'user ' || user_id || ' Bearer [REDACTED], Api Key=[REDACTED]; sk-[REDACTED] password=[REDACTED], sk-short' AS line FROM events",
    "json_compress": "SELECT conv_id, to_json(list_transform(list_slice(list(text ORDER BY turn), 1, 3), lambda x: CASE WHEN length(x) > 100 THEN substring(x, 1, 100) || '...' ELSE x END)) :: varchar AS log FROM conversations GROUP BY conv_id",
    "validate_args": f"SELECT event_id, {_ERROR} AS error FROM events",
    "action_fingerprint": """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN event_type || ':not { json' ELSE event_type || ':{"a":{"k":' || json_extract_string(props, '$.k') || '},"b":[1,2],"c":"x  y"}' END AS fp FROM events""",
    "tool_spec": f"""WITH c AS (SELECT event_id, event_id % 5 AS t, event_id % 7 AS a, cast(user_id % 30 AS varchar) AS nation, {_SEGMENT} AS segment FROM events), s AS (SELECT c_mktsegment AS segment, count(*) AS n, round(max(c_acctbal), 2) AS best FROM customer GROUP BY 1), g AS (SELECT cast(c_nationkey AS varchar) AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2),
        e AS (SELECT c.*, CASE WHEN t = 0 OR t = 2 THEN 'unknown_tool' WHEN a = 0 THEN 'invalid_json' WHEN a = 1 THEN 'arguments_must_be_object' WHEN a = 2 THEN 'missing_required' WHEN a = 3 THEN 'invalid_type' WHEN a = 4 THEN 'empty_required' END AS wrong FROM c),
        d AS (SELECT e.*, CASE WHEN wrong IS NULL AND t = 1 THEN '{{"customers":' || g.n || '}}' WHEN wrong IS NULL THEN '{{"customers":' || s.n || ',"richest":' || s.best || '}}' END AS data FROM e LEFT JOIN s ON s.segment = e.segment LEFT JOIN g ON g.segment = e.segment AND g.nation = e.nation)
        SELECT event_id, data IS NOT NULL AS ok, data, coalesce(wrong, CASE WHEN data IS NULL THEN 'tool_failed' END) AS error FROM d""",
    "provider": "SELECT event_id, CASE WHEN event_type <> 'error' THEN reverse(event_type || '-' || event_id) END AS value, CASE WHEN event_type = 'error' THEN 'no answer' END AS error, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS attempts FROM events",
    "embed_batch": "SELECT doc_id, cast(length(t) AS double) AS chars, cast(length(t) - length(replace(t, 'a', '')) AS double) AS a FROM (SELECT doc_id, 'Question: ' || source || E'\\nAnswer: ' || substring(text, 1, 500) AS t FROM documents) q",
    "hook_pipeline": """SELECT event_id, event_type, round(CASE WHEN event_type IN ('error', 'view') THEN value ELSE value + 1 END, 3) AS value, CASE WHEN event_type = 'error' OR (event_type <> 'view' AND value + 1 > 100) THEN NULL ELSE round(2 * (CASE WHEN event_type = 'view' THEN value ELSE value + 1 END), 3) END AS double,
        CASE WHEN event_type = 'error' THEN 'no errors' WHEN event_type <> 'view' AND value + 1 > 100 THEN 'too large' END AS blocked_by FROM events""",
    "subagent": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN k <= 5 THEN 'done' ELSE 'max_steps' END AS status, cast(CASE WHEN event_type = 'error' THEN 1 ELSE greatest(1, least(5, k)) END AS int) AS steps, CASE WHEN event_type = 'error' THEN 'cannot' END AS error, CASE WHEN event_type <> 'error' THEN greatest(1, least(5, k)) END AS visits FROM (SELECT *, event_id % 9 AS k FROM events) q",
    "skill": "SELECT doc_id, length(lower(trim(text))) AS chars, CASE WHEN length(lower(trim(text))) > 1000 THEN 'long' ELSE 'short' END AS grade FROM documents",
    "state_graph": "SELECT doc_id, 'read' || CASE WHEN n_chars < 200 THEN '>upper' WHEN lang = 'en' THEN '>lower' ELSE '' END || '>end' AS steps, md5(CASE WHEN n_chars < 200 THEN upper(text) WHEN lang = 'en' THEN lower(text) ELSE text END) AS state FROM documents",
    "loop_until": "WITH RECURSIVE r AS (SELECT doc_id, n_chars AS size, 0 AS rounds FROM documents UNION ALL SELECT doc_id, cast(floor(size / 2) AS bigint) AS size, rounds + 1 AS rounds FROM r WHERE size > 100) SELECT doc_id, size, rounds FROM r WHERE size <= 100",
    "reducer_udaf": "SELECT conv_id, string_agg(array_to_string(string_split(role, 's'), ','), ',' ORDER BY turn) AS parts FROM conversations GROUP BY conv_id",
    "splitter_udtf": "SELECT conv_id, turn, i - 1 AS line_no, lines[i] AS line FROM (SELECT conv_id, turn, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, E'\\n') AS lines FROM conversations) a) b WHERE lines[i] <> ''",
    "parse_md_sections": "SELECT '/kb/d' || doc_id || '.md' AS path, i AS index, CASE i WHEN 1 THEN length('## Q: of ' || doc_id || '|> 来源: ' || source || '|**新手答**: \"plain ' || lang || '\"||**高手答**:|first ' || n_chars || '|second||**差距在哪**: depth||---|') ELSE length('### Q：again|**新手答**: x|') END AS chars FROM documents CROSS JOIN (VALUES (1), (2)) AS t(i)",
    "parse_md_fields": "SELECT 'd' || doc_id || ':1' AS id, 'd' || doc_id AS dimension, 'of ' || doc_id AS question, source, 'plain ' || lang AS novice_answer, 'first ' || n_chars || E'\\nsecond' AS expert_answer, 'depth' AS gap FROM documents",
    "scan_md_qa": "SELECT * FROM (VALUES ('a:1', 'one', 'yes', 'g', 'First'), ('b:1', 'two', 'no', 'h', 'Second')) AS t(id, question, expert_answer, gap, dimension_label)",
    "scan_frontmatter": "SELECT '/s/' || doc_id || '/SKILL.md' AS path, 's' || doc_id AS name, 'about ' || lang || ': more' AS description, 'body ' || n_chars AS body FROM documents",
    "scan_json_dir": "SELECT cast(i AS bigint) AS id, 't' || i AS subject, cast(i - 1 AS bigint) AS blocker FROM (VALUES (0), (1), (2)) AS t(i)",
    "write_file": "SELECT 15 AS bytes, value FROM (VALUES ('first'), ('second é')) AS t(value)",
    "sink_trace_jsonl": """SELECT '{"event":"tool_result","event_id":' || event_id || ',"password":"[REDACTED]","header":"Bearer [REDACTED]"}' AS value FROM events""",
    "sink_report_file": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "sse_sink": """SELECT row_number() OVER (ORDER BY event_id) AS id, 'id: ' || row_number() OVER (ORDER BY event_id) || E'\\nevent: progress\\ndata: {"event_id":' || event_id || ',"event_type":"' || event_type || E'"}\\n\\n' AS message FROM events""",
    "cdc_sync": "SELECT user_id, position, event_type FROM (SELECT user_id, event_id AS position, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id % 3 > 0 OR event_id % 2 = 0) q WHERE r = 1 AND event_type <> 'error'",
    "sink_kb_upsert": "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'xx' ELSE coalesce(lang, '') END AS lang FROM documents WHERE doc_id % 10 <> 7 UNION ALL SELECT doc_id + 1000000000 AS doc_id, coalesce(lang, '') AS lang FROM documents WHERE doc_id % 10 = 4",
    "ext_missed_changes": "SELECT CASE WHEN doc_id % 10 = 4 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE doc_id % 10 WHEN 3 THEN 'update' WHEN 7 THEN 'insert' ELSE 'delete' END AS action FROM documents WHERE doc_id % 10 = 7 OR doc_id % 10 = 4 OR (doc_id % 10 = 3 AND coalesce(lang, '') <> 'xx')",
    "synthetic_sql_filter": "SELECT * FROM (VALUES ('one', 'kept'), ('all', 'whole_table'), ('none', 'empty'), ('bad', 'failed'), ('syntax', 'failed'), ('count', 'kept')) AS t(query, status)",
    "split_labeled": """WITH s AS (SELECT conv_id, turn, role, trim(translate(text, ':：', '  '), E' \\t\\r\\n') AS said FROM conversations), t AS (SELECT *, lag(CASE WHEN role = 'user' THEN said END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM s WHERE role <> 'user' OR said <> '')
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pair, md5(asked) AS question, md5(said) AS answer FROM t WHERE role <> 'user' AND asked IS NOT NULL""",
    "title_path": """SELECT doc_id, cast(i AS int) AS line_no, replace(replace(line, 'ID', cast(doc_id AS varchar)), 'LANG', substring(lang, 1, 1)) AS line, replace(path, 'ID', cast(doc_id AS varchar)) AS path FROM documents
        CROSS JOIN (VALUES (0, '# DID', 'DID'), (1, 'LANG', 'DID'), (2, '## A', 'DID > A'), (3, 'x', 'DID > A'), (4, '### B', 'DID > A > B'), (5, 'y', 'DID > A > B'), (6, '## C', 'DID > C'), (7, 'z', 'DID > C'), (8, '# E', 'E'), (9, '### F', 'E > F'), (10, 'w', 'E > F')) AS t(i, line, path)""",
    "listing_budget": """WITH RECURSIVE d AS (SELECT source, doc_id, 6 + length(cast(doc_id AS varchar)) AS short, 8 + length(cast(doc_id AS varchar)) + least(length(coalesce(text, '')), 252) AS full_size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
        r AS (SELECT source, doc_id, n, CASE WHEN full_size <= 8000 THEN full_size ELSE short END AS total, full_size <= 8000 AS full_text FROM d WHERE n = 1 UNION ALL SELECT d.source, d.doc_id, d.n, r.total + CASE WHEN r.total + d.full_size <= 8000 THEN d.full_size ELSE d.short END, r.total + d.full_size <= 8000 FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1) SELECT source, doc_id, full_text FROM r""",
    "rate_sliding": _fold("CASE WHEN len(h) < 3 THEN list_append(h, us) ELSE h END, len(h) < 3", "[us] AS held, true AS allowed", "list_filter(r.held, lambda x: x > ev.us - 86400000000) AS h", "allowed"),
    "rate_token_bucket": _fold("CASE WHEN l >= 1 THEN l - 1 ELSE l END, l >= 1", "2.0 :: double AS level, true AS allowed", "least(3.0, r.level + (ev.us - r.us) / 1e6 / 43200) AS l", "allowed"),
    "rate_leaky": _fold("CASE WHEN l + 1 <= 3 THEN l + 1 ELSE l END, l + 1 <= 3", "1.0 :: double AS level, true AS allowed", "greatest(0.0, r.level - (ev.us - r.us) / 1e6 / 43200) AS l", "allowed"),
    "token_bucket": _fold(
        "greatest(0.0, l - 1), CASE WHEN l >= 1 THEN pos ELSE pos + (1 - l) * 43200 END", "2.0 :: double AS level, us / 1e6 AS served", "greatest(ev.us / 1e6, r.served) AS pos, least(3.0, r.level + (greatest(ev.us / 1e6, r.served) - r.served) / 43200) AS l", "round(served - us / 1e6, 2) AS wait_s"
    ),
    "dedup_minhash": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) a),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a) SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a""",
    "dedup_cosine": f"WITH {_MOVED} SELECT x.id AS a, y.id AS b, round({_COSINE}, 4) AS score FROM b x JOIN b y ON x.id < y.id WHERE {_COSINE} > 0.95",
    "memory_semantic_merge": f"WITH RECURSIVE {_CLASSES} SELECT class_id, count(*) AS confidence, max(id) AS newest FROM cl GROUP BY class_id",
    "dedup_semantic": f"""WITH RECURSIVE {_MOVED}, n AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON {_COSINE} >= 0.85), core AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 3),
        l AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), c AS (SELECT a AS id, min(b) AS class_id, 'core' AS kind FROM reach GROUP BY a),
        k AS (SELECT * FROM c UNION ALL SELECT n.a, min(c.class_id), 'border' FROM n JOIN c ON c.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a), cl AS (SELECT v.id, coalesce(k.class_id, v.id) AS class_id, coalesce(k.kind, 'noise') AS kind FROM v LEFT JOIN k ON k.id = v.id)
        SELECT class_id, id, size, kind FROM (SELECT class_id, id, kind, count(*) OVER (PARTITION BY class_id) AS size, row_number() OVER (PARTITION BY class_id ORDER BY id % 1000003 % 101 DESC, id) AS r FROM cl) q WHERE r = 1""",
    "dedup_simhash_chunk": r"""WITH RECURSIVE t AS (SELECT text, md5(text) AS h, count(*) AS copies FROM (SELECT unnest(string_split(text, E'\n')) AS text FROM documents) q GROUP BY text), w AS (SELECT h, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM t),
        s AS (SELECT DISTINCT h, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT h, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0) a), n AS (SELECT h, count(*) AS n FROM s GROUP BY h),
        p AS (SELECT x.h AS a, y.h AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.h <> y.h GROUP BY x.h, y.h), l AS (SELECT a, b FROM p JOIN n x ON x.h = a JOIN n y ON y.h = b WHERE c / (x.n + y.n - c) > 0.85), reach AS (SELECT h AS a, h AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), c AS (SELECT a AS h, min(b) AS class_id FROM reach GROUP BY a)
        SELECT h AS text_hash, copies, class_id, r = 1 AS kept FROM (SELECT c.h, t.copies, c.class_id, row_number() OVER (PARTITION BY c.class_id ORDER BY t.copies DESC, c.h) AS r FROM c JOIN t ON t.h = c.h) q""",
    "topo_waves": "WITH RECURSIVE e AS (SELECT cast(floor(event_id / 3) AS bigint) AS u, event_id AS v FROM events WHERE event_id > 0 UNION SELECT cast(floor(event_id / 4) AS bigint) AS u, event_id AS v FROM events WHERE event_id > 0), walk AS (SELECT 0 :: bigint AS node, 0 AS wave UNION SELECT e.v, w.wave + 1 FROM walk w JOIN e ON e.u = w.node) SELECT node, max(wave) AS wave FROM walk GROUP BY node",
    "causal_chain": "WITH RECURSIVE w AS (SELECT event_id, event_id AS pos, 0 AS chain FROM events UNION ALL SELECT event_id, cast(floor(pos / 3) AS bigint), chain + 1 FROM w WHERE pos > 0) SELECT event_id, cast(max(chain) AS bigint) AS chain FROM w GROUP BY event_id",
    "call_cycle": "WITH RECURSIVE w AS (SELECT event_id, user_id % 40 AS agent, event_id AS pos, 0 AS distance FROM events UNION ALL SELECT event_id, agent, cast(floor(pos / 3) AS bigint), distance + 1 FROM w WHERE pos > 0) SELECT w.event_id, min(w.distance) AS distance FROM w JOIN events p ON p.event_id = w.pos WHERE w.distance > 0 AND p.user_id % 40 = w.agent GROUP BY w.event_id",
    "knowledge_graph": "WITH RECURSIVE m AS (SELECT 'u' || user_id AS s, 't' || user_id % 30 || '-' || cast(json_extract_string(props, '$.k') AS bigint) % 5 AS o, count(*) AS support FROM events GROUP BY 1, 2 HAVING count(*) >= 2), l AS (SELECT s AS a, o AS b FROM m UNION SELECT o AS a, s AS b FROM m), reach AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS community FROM reach GROUP BY a) SELECT m.s, m.o, m.support, c.community FROM m JOIN c ON c.a = m.s",
    "stream_assemble": """SELECT * FROM (VALUES ('s1', 'completed', 'Checking ', '{"c1": "{\\"city\\":\\"Shanghai\\"}"}', NULL), ('s2', 'error', 'cut off', '{}', 'no_completion'), ('s3', 'error', '', '{}', 'after_terminal'), ('s4', 'error', '', '{}', 'unknown_type'), ('s5', 'error', '', '{}', 'missing_call_id'), ('s6', 'error', 'ab', '{}', 'response_error')) AS t(stream_id, status, text, arguments, error)""",
    "stream_parse_gateway": """SELECT cast(event_id AS varchar) AS stream_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'tool_use' END AS kind, event_type AS text, CASE WHEN event_type <> 'error' THEN '[{"id": "c' || event_id || '", "name": "look", "input": {"k": ' || json_extract_string(props, '$.k') || '}}]' END AS tools,
        CASE WHEN event_type = 'error' THEN 'end_turn' ELSE 'tool_use' END AS stop_reason, CASE WHEN event_type = 'error' THEN 0 ELSE event_id END AS input_tokens, CASE WHEN event_type = 'error' THEN 'invalid_arguments' END AS error FROM events""",
}
