"""Replays of the given tables through file streams, each with SQL that computes the whole at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quarrystone.operators.tables import fresh_dir
from quarrystone.sources import inbox
from quarrystone.streaming import stateful


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _replayed(rows: DataFrame, parts: list[Column], folder: str) -> DataFrame:
    """A stream over ``rows``, written as one part after the other and read in that order, a part's file a micro-batch."""
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark = rows.sparkSession
    stateful.use_state_store(spark)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _started(stream: DataFrame, folder: str) -> StreamingQuery:
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream writes until its input is at an end."""
    _started(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def idle_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the users that ended by a day of silence, by timers over four micro-batches of events in time order."""
    folder = fresh_dir(spark, "idle")
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    cut = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    place = F.floor((F.unix_micros("ts") - cut.a) * 4 / (cut.b - cut.a + 1))
    stream = _replayed(events, [place == i for i in range(4)], folder).withWatermark("ts", "0 seconds")
    return _drained(stateful.idle_sessions(stream, "1 day"), folder).select("user_id", "last_id", "events")


def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive up to 4,000 seconds late, put in order by user; those over 2,700 seconds late are set apart."""
    folder = fresh_dir(spark, "reorder")
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("payload"))
    events = events.withColumn("arrived", F.timestamp_micros(F.unix_micros("ts") + F.expr("event_id * 7919 % 5") * 1_000_000_000))
    last = events.agg(F.min(F.unix_micros("arrived")).alias("a"), F.max(F.unix_micros("arrived")).alias("b")).first()
    # one more row after all others, so that the watermark passes them
    after = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), *[F.timestamp_micros(F.lit(last.b + 86_400_000_000)).alias(c) for c in ("ts", "arrived")], F.lit("").alias("payload"))
    rows = events.unionByName(after).select("user_id", "event_id", "ts", "arrived", "payload")
    place = F.floor((F.unix_micros("arrived") - last.a) * 3 / (last.b - last.a + 1))
    stream = _replayed(rows, [place == 0, place == 1, place == 2, place > 2], folder)
    return _drained(stateful.reorder(stream, "2700 seconds"), folder).where("user_id >= 0").select("user_id", "event_id", "pos", "late")


def dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of messages, some told twice: retries, and dead letters at the third failure."""
    folder = fresh_dir(spark, "dlq")
    failed = F.col("event_type").isin("error", "view", "click")
    attempts = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 6).alias("message"), (F.col("event_id") % 6).alias("seq"), failed.alias("failed"))
    stream = _replayed(attempts, [F.col("seq") < 3, F.col("seq") > 0], folder)
    stateful.two_sinks(stateful.route_attempts(stream, 3), folder, f"{folder}/cp").awaitTermination()
    return stateful.read_routed(spark, folder, "retry").unionByName(stateful.read_routed(spark, folder, "dead"))


def _lines(rows: DataFrame, output: Column, folder: str) -> None:
    rows.select(output.alias("inbox"), F.to_json(F.struct(*rows.columns)).alias("value")).repartition("inbox").write.mode("append").partitionBy("inbox").text(folder)


def _drain(spark: SparkSession, uri: str, consumer: str, out: str) -> DataFrame:
    spark.dataSource.register(inbox.LineSource)
    stream = spark.readStream.format("appended_lines").option("path", uri).option("consumer", consumer).load()
    inbox.settle(_started(stream, out), uri, consumer)
    return spark.read.schema(stream.schema).parquet(f"{out}/out")


def _shared_uri(spark: SparkSession, name: str) -> str:
    folder = fresh_dir(spark, name)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def inbox_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of 20 inboxes in two deliveries, drained after each by a query that is started anew."""
    folder, out = _shared_uri(spark, "inbox"), fresh_dir(spark, "drained")
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    _lines(events.where("event_id % 3 > 0"), F.col("user_id") % 20, folder)
    _drain(spark, folder, "agent", out)
    _lines(events.where("event_id % 3 = 0"), F.col("user_id") % 20, folder)
    read = _drain(spark, folder, "agent", out)
    return read.select(F.regexp_extract("output", r"inbox=(\d+)", 1).cast("long").alias("inbox"), F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), F.get_json_object("line", "$.event_type").alias("event_type"))


def output_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that grow: what each of three looks finds new, each a query of its own that goes on from the cursor."""
    folder, out = _shared_uri(spark, "outputs"), fresh_dir(spark, "deltas")
    turns, looks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars")), []
    for look in range(3):
        _lines(turns.where(F.col("turn") % 3 == look).withColumn("look", F.lit(look)), F.col("conv_id") % 8, folder)
        looks.append(_drain(spark, folder, "watcher", f"{out}/{look}").withColumn("seen", F.lit(look)))
    found = looks[0].unionByName(looks[1]).unionByName(looks[2])
    fields = [F.get_json_object("line", f"$.{c}").cast("long").alias(c) for c in ("conv_id", "turn", "chars")]
    return found.select(*fields, "seen").groupBy("conv_id", "seen").agg(F.count("*").alias("turns"), F.sum("chars").alias("chars"))


QUERIES = {f.__name__: f for f in (idle_timeout, out_of_order, dlq, inbox_drain, output_delta)}

SQL = {
    "idle_timeout": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, max(epoch_us(ts)) OVER () AS latest FROM events),
        s AS (SELECT *, sum(CASE WHEN us - before > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM e)
        SELECT user_id, event_id AS last_id, events FROM (SELECT *, count(*) OVER (PARTITION BY user_id, session) AS events FROM s) q WHERE after - us > 86400000000 OR (after IS NULL AND latest // 1000 >= us // 1000 + 86400001)""",
    "out_of_order": "SELECT user_id, event_id, CASE WHEN NOT late THEN row_number() OVER (PARTITION BY user_id, late ORDER BY ts, event_id) END AS pos, late FROM (SELECT *, event_id * 7919 % 5 * 1000 > 2700 AS late FROM events) q",
    "dlq": """WITH a AS (SELECT event_id // 6 AS message, event_id % 6 AS seq, event_type IN ('error', 'view', 'click') AS failed FROM events), c AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY message ORDER BY seq) AS failures, min(CASE WHEN NOT failed THEN seq END) OVER (PARTITION BY message) AS done FROM a)
        SELECT message, seq, cast(failures AS bigint) AS failures, CASE WHEN failures = 3 THEN 'dead' ELSE 'retry' END AS route FROM c WHERE failed AND failures <= 3 AND (done IS NULL OR seq < done)""",
    "inbox_drain": "SELECT user_id % 20 AS inbox, event_id, event_type FROM events",
    "output_delta": "SELECT conv_id, cast(turn % 3 AS int) AS seen, count(*) AS turns, cast(sum(length(text)) AS bigint) AS chars FROM conversations GROUP BY ALL",
}
