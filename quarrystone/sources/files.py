"""File sources and sinks of the kinds that agent tools use: Markdown, front matter, JSON and JSON lines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrystone.operators.messages import redact_json
from quarrystone.operators.tables import free_names, numbered


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_json_dir(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def question_sections(files: DataFrame) -> DataFrame:
    """(path, index, section): Markdown sections whose heading begins 'Q:', numbered from 1 in each file."""
    parts = F.filter(F.split("content", r"(?m)(?=^#{2,3}\s*Q[：:])"), lambda x: x.rlike(r"(?m)^#{2,3}\s*Q[：:]"))
    return files.select("path", F.posexplode(parts).alias("index", "section")).withColumn("index", F.col("index") + 1)


# The marks of a section's fields.
_FIELDS = {
    "question": r"(?m)^#{2,3}\s*Q[：:]\s*(.+)",
    "source": r">\s*来源[：:]\s*(.+)",
    "novice_answer": r"(?m)\*\*新手答\*\*[：:]\s*[\"“”]?(.+?)[\"“”]?\s*$",
    "expert_answer": r"\*\*高手答\*\*[：:]\s*\n([\s\S]+?)(?=\n\*\*(?:差距|考察|关键))",
    "gap": r"\*\*(?:差距在哪|考察点|关键差距)\*\*[：:]\s*([\s\S]+?)(?=\n---|\n#{2,3}\s|\z)",
}


def question_fields(sections: DataFrame) -> DataFrame:
    """(id, dimension, question, source, novice_answer, expert_answer, gap) of each section; one without an expert answer goes.

    The id is the file's name and the section's index; a field that is not
    there is empty.
    """
    fields = [F.trim(F.regexp_extract("section", pattern, 1), F.lit(" \t\r\n")).alias(name) for name, pattern in _FIELDS.items()]
    dimension = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    rows = sections.select(F.concat_ws(":", dimension, "index").alias("id"), dimension.alias("dimension"), *fields)
    return rows.where("question <> '' AND expert_answer <> ''")


def read_questions(spark: SparkSession, path: str, dimensions: dict[str, str]) -> DataFrame:
    """The fields of one Markdown file for each dimension, with the dimension's label; other files of the folder are not read."""
    files = read_texts(spark, [f"{path}/{name}.md" for name in dimensions])
    labels = F.create_map(*[F.lit(x) for pair in dimensions.items() for x in pair])
    return question_fields(question_sections(files)).withColumn("dimension_label", labels[F.col("dimension")])


def list_dir(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of the files below a folder, wherever it lies; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def write_file(spark: SparkSession, path: str, text: str) -> int:
    """Write one small text file, over what was there; returns its bytes."""
    raw = text.encode()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(raw)
    out.close()
    return len(raw)


def front_matter(files: DataFrame) -> DataFrame:
    """(path, name, description, body) of files that begin with a '---' block."""
    head = F.regexp_extract("content", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1))
    return files.select("path", field("name").alias("name"), field("description").alias("description"), F.regexp_replace("content", r"(?s)^---\n.*?\n---\n?", "").alias("body"))


class Trace:
    """A folder of JSON lines, begun anew, in which each record is written without its secrets."""

    def __init__(self, spark: SparkSession, path: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.path = path

    def record(self, events: DataFrame, event: str) -> None:
        """Append each row as one JSON object with the name of the event; nested fields are redacted by name too."""
        line = redact_json(F.to_json(F.struct(F.lit(event).alias("event"), *events.columns)))
        events.select(line.alias("value")).write.mode("append").text(self.path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def server_events(rows: DataFrame, event: str, order: list[str]) -> DataFrame:
    """(id, message): each row as a server-sent event, numbered in ``order``.

    Rows are numbered by ranges of the order, so no task holds them all.
    """
    (number,) = free_names(rows, "event_number")
    body = F.to_json(F.struct(*rows.columns))
    sent = numbered(rows, order, number)
    message = F.concat(F.lit("id: "), F.col(number).cast("string"), F.lit(f"\nevent: {event}\ndata: "), body, F.lit("\n\n"))
    return sent.select(F.col(number).alias("id"), message.alias("message"))


def stream_server_events(stream: DataFrame, event: str, order: list[str], send: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch as server-sent events, handed to ``send``."""
    return stream.writeStream.foreachBatch(lambda batch, _: send(server_events(batch, event, order))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missed_changes(source: DataFrame, synced: DataFrame, key: str) -> DataFrame:
    """(key, action) that would make ``synced`` equal to ``source`` again: insert, update or delete."""
    hashed = lambda df, n: df.select(F.col(key).alias(f"k{n}"), F.xxhash64(*sorted(c for c in source.columns if c != key)).alias(f"h{n}"))
    both = hashed(source, 1).join(hashed(synced, 2), F.col("k1") == F.col("k2"), "full")
    action = F.when(F.col("k2").isNull(), "insert").when(F.col("k1").isNull(), "delete").when(F.col("h1") != F.col("h2"), "update")
    return both.select(F.coalesce("k1", "k2").alias(key), action.alias("action")).where("action IS NOT NULL")


def working_queries(spark: SparkSession, queries: dict[str, str], whole: dict[str, int]) -> dict[str, str]:
    """The status of each SQL text: failed, empty, whole_table, or kept.

    ``whole`` has the number of rows of each table; a query that returns as
    many as a table it names asks nothing.  Whether a query fits its question
    is for a model and left out.  One count a query comes to the driver.
    """
    out = {}
    for name, text in queries.items():
        try:
            rows = spark.sql(text).count()
        except Exception:  # a query that does not run is what is looked for
            out[name] = "failed"
            continue
        named = {t for t in whole if re.search(rf"\b{re.escape(t)}\b", text, re.I)}
        out[name] = "empty" if not rows else "whole_table" if any(whole[t] == rows for t in named) else "kept"
    return out
