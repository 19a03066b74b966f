"""Streams with state and the source of appended lines: the same rows at any cut, frame size and restart."""

import json
import time

import pytest

from quarrystone.sources import inbox
from quarrystone.streaming import assemble, stateful


@pytest.fixture(params=[1, 10000])
def frames(spark, request):
    """Arrow frames of one row, and of many."""
    stateful.use_state_store(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def replay(spark, parts, schema, make, folder, timers=False):
    """Rows that ``make``'s stream writes over ``parts``, a micro-batch each, until the input is at an end; a query with timers of the clock never ends by itself."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.01)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    query = (writer if timers else writer.trigger(availableNow=True)).start()
    try:
        began = time.monotonic()
        while time.monotonic() - began < 90 and query.isActive and not (timers and sum(p.numInputRows for p in query.recentProgress) >= sum(map(len, parts))):
            time.sleep(0.2)
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


EVENTS = "stream_id string, seq int, kind string, call_id string, delta string"


def test_assembly_does_not_depend_on_frames_or_batches(spark, frames, tmp_path):
    """Events in any order, in one micro-batch and over several: the stream gives what the batch gives."""
    rows = [
        ("a", 4, "response.completed", None, None), ("a", 2, "text.delta", None, "B"), ("a", 3, "text.delta", None, "C"), ("a", 1, "text.delta", None, "A"),
        ("b", 1, "tool.arguments.delta", "c", '{"x"'), ("b", 3, "response.completed", None, None), ("b", 2, "tool.arguments.delta", "c", ": 1}"), ("c", 2, "text.delta", None, "late"), ("c", 1, "response.completed", None, None),
        ("d", 1, "odd", None, None), ("d", 2, "response.completed", None, None), ("e", 1, "tool.arguments.delta", "c", "{"), ("e", 2, "response.completed", None, None),
    ]
    want = {r.stream_id: tuple(r) for r in assemble.assemble(spark.createDataFrame(rows, EVENTS)).collect()}
    assert want["a"][:3] == ("a", "completed", "ABC") and want["b"][3] == '{"c": "{\\"x\\": 1}"}' and want["c"][4] == "after_terminal" and want["d"][4] == "unknown_type" and want["e"][4] == "invalid_arguments"
    for name, parts in (("one", [rows]), ("many", [rows[:2], rows[2:3], rows[3:6], rows[6:9], rows[9:]])):
        got = replay(spark, parts, EVENTS, assemble.assemble_stream, f"{tmp_path}/{name}", True)
        assert {r.stream_id: tuple(r) for r in got} == want and len(got) == len(want)


def test_assembly_after_its_end_and_when_idle(spark, tmp_path):
    """What comes after an end gives one more row; a stream with a gap or no end leaves when it has been idle."""
    stateful.use_state_store(spark)
    parts = [[("a", 1, "text.delta", None, "hi"), ("a", 2, "response.completed", None, None), ("b", 1, "text.delta", None, "x"), ("b", 3, "text.delta", None, "z")], [("a", 3, "text.delta", None, "late")], [("a", 4, "text.delta", None, "later")]]
    got = replay(spark, parts, EVENTS, assemble.assemble_stream, tmp_path / "x", True)
    assert sorted(tuple(r)[:3] + (r.error,) for r in got) == [("a", "completed", "hi", None), ("a", "error", "hi", "after_terminal")]
    seen = []
    spark.createDataFrame(parts[0], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = assemble.assemble_stream(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), "2 seconds")
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend((r.stream_id, r.text, r.error) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        began = time.monotonic()
        while len(seen) < 2 and time.monotonic() - began < 60:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(seen) == [("a", "hi", None), ("b", "xz", "no_completion")]


CLICKS = "user_id long, event_id long, ts timestamp"


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_idle_sessions_by_the_clock(spark, tmp_path):
    """A session closes when the clock says so, though no event follows."""
    stateful.use_state_store(spark)
    spark.createDataFrame([(1, 1, at(0)), (1, 2, at(500)), (2, 3, at(9))], CLICKS).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = stateful.idle_sessions(spark.readStream.schema(CLICKS).parquet(f"{tmp_path}/in"), "1 second", event_time=False, keep="1 day")
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend((r.user_id, r.last_id, r.events, r.closed_by) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        began = time.monotonic()
        while len(seen) < 2 and time.monotonic() - began < 60:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(seen) == [(1, 2, 2, "timer"), (2, 3, 1, "timer")]


ARRIVALS = "user_id long, event_id long, ts timestamp, arrived timestamp, payload string"


@pytest.mark.parametrize("cuts", [1, 7])
def test_reorder_at_any_cut(spark, frames, tmp_path, cuts):
    import random

    rnd = random.Random(5)
    rows = [(i % 3, i, at(t), at(t + rnd.choice([0, 5, 10, 40])), f"p{i}") for i, t in enumerate(rnd.choices(range(300), k=120))]
    rows = sorted(rows, key=lambda r: r[3]) + [(9, 999, at(9000), at(9000), None)]
    size = -(-len(rows) // cuts)
    got = replay(spark, [rows[i : i + size] for i in range(0, len(rows), size)], ARRIVALS, lambda s: stateful.reorder(s, "10 seconds"), tmp_path)
    late = {r[1] for r in rows if (r[3] - r[2]).total_seconds() > 10}
    assert {r.event_id for r in got if r.late} == late and all(r.pos is None for r in got if r.late)
    for user in range(3):
        want = [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1])) if r[0] == user and r[1] not in late]
        assert [(r.pos, r.event_id) for r in sorted((r for r in got if r.user_id == user and not r.late), key=lambda r: r.pos)] == list(enumerate(want, 1))


def test_attempts_are_routed_once(spark, tmp_path):
    """Attempts told twice, over batches, and a batch that is written again after its commit was lost."""
    stateful.use_state_store(spark)
    schema = "message long, seq long, failed boolean"
    rows = [(1, s, True) for s in range(5)] + [(2, 0, True), (2, 1, False), (2, 2, True)] + [(3, 0, False)]
    for part in (rows[:4], rows[2:], rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.route_attempts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3)
        stateful.two_sinks(stream, f"file://{tmp_path}", f"file://{tmp_path}/cp").awaitTermination()
    got = {route: sorted((r.message, r.seq, r.failures) for r in stateful.read_routed(spark, f"file://{tmp_path}", route).collect()) for route in ("retry", "dead")}
    assert got == {"retry": [(1, 0, 1), (1, 1, 2), (2, 0, 1)], "dead": [(1, 2, 3)]}
    newest = max(int(p.name) for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    for name in (str(newest), f".{newest}.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)  # Spark runs the batch again
    stream = stateful.route_attempts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3)
    stateful.two_sinks(stream, f"file://{tmp_path}", f"file://{tmp_path}/cp").awaitTermination()
    assert {route: sorted((r.message, r.seq, r.failures) for r in stateful.read_routed(spark, f"file://{tmp_path}", route).collect()) for route in got} == got


def test_appended_lines(spark, tmp_path):
    """Files that grow, lines that are half written, pieces shorter than a line, two consumers, restarts, and ended outputs that go."""
    spark.dataSource.register(inbox.LineSource)
    box = tmp_path / "box"
    box.mkdir()
    uri = f"file://{box}"

    def drain(consumer, run, piece=7):
        stream = spark.readStream.format("appended_lines").option("path", uri).option("consumer", consumer).option("piece", piece).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{run}/out").option("checkpointLocation", f"{tmp_path}/{run}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        inbox.settle(query, uri, consumer)
        return sorted((r.output, r.position, r.line) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/{run}/out").collect())

    (box / "a").write_bytes("one\na long line that is cut é\n\nhal".encode())
    (box / "b").write_bytes(b"")
    first = drain("x", "x")
    assert [t[2] for t in first] == ["one", "a long line that is cut é", ""] and first[1][1] == 4
    with (box / "a").open("ab") as file:
        file.write(b"f a line\nlast\n")
    (box / "b").write_bytes(b"bee\n")
    (box / "a.ended").touch()
    assert [t[2] for t in drain("x", "x")] == ["one", "a long line that is cut é", "", "half a line", "last", "bee"]  # the same checkpoint
    assert not (box / "a").exists() and not (box / "a.ended").exists() and (box / "b").exists()
    assert [t[2] for t in drain("y", "y", 1 << 20)] == ["bee"]
    (box / "b.ended").touch()
    with (box / "b").open("ab") as file:
        file.write(b"more\n")
    assert [t[2] for t in drain("y", "y2")] == ["more"] and (box / "b").exists()  # a new checkpoint goes on from the cursor; x has not had it
    assert [t[2] for t in drain("x", "x2")] == ["more"] and not (box / "b").exists()
    assert json.loads((box / "_cursors" / "x.json").read_text())["b"] == 9
