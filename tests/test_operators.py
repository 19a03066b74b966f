"""Operators that are folds, recursions or streams, on small golden inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import columns
from quarrystone.operators import chunks, components, folds, intervals, leaks, messages, pages, rates, search, similar, tables, vectors
from quarrystone.plans import tools, walks
from quarrystone.plans.graph import Registry, StateGraph, loop_until
from quarrystone.queries import procedures
from quarrystone.sources import files, merge_table


def test_redaction():
    value = {"authorization": "Bearer top-secret", "x-api-key": "k", "client_secret": "c", "cookie": 2, "nested": ["Bearer token", "password=secret123", 1, None], "inner": '  {"api_key": "zzz", "n": 1}', "s": "sk-abcdefgh123"}
    once = messages.redact_value(value)
    assert {once[k] for k in ("authorization", "x-api-key", "client_secret", "cookie")} == {"[REDACTED]"}
    assert once["nested"] == ["Bearer [REDACTED]", "password=[REDACTED]", 1, None] and once["s"] == "sk-[REDACTED]"
    assert once["inner"] == '{"api_key":"[REDACTED]","n":1}' and messages.redact_value(once) == once
    hidden = messages.redact_value(dict.fromkeys(["passwd", "id_token", "auth_token", "x_auth_token", "My-Refresh-Token"], "v"))
    assert set(hidden.values()) == {"[REDACTED]"} and messages.redact_value({"token": "v", "secretary": "s"}) == {"token": "v", "secretary": "s"}
    assert messages.redact_value("api key: zzz, then") == "api key=[REDACTED], then"
    assert messages.redact_value("{ no json, bearer  a/b=c;x") == "{ no json, Bearer [REDACTED];x"


def test_redact_plain_equals_the_python_form(spark):
    lines = ["Bearer abc, x", "PASSWORD = 'q w", "client secret:abc;d", "sk-12345678 sk-1234567", "refresh-token= x y", "", None]
    df = spark.createDataFrame([(x,) for x in lines], "a string")
    assert [r.a for r in df.select(messages.redact_plain(F.col("a")).alias("a")).collect()] == [x and messages.redact_value(x) for x in lines]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("{", "invalid_json"), ("[1]", "arguments_must_be_object"), ("3", "arguments_must_be_object"), ("{}", "missing_required"), ('{"city":null}', "invalid_type"),
        ('{"city":123}', "invalid_type"), ('{"city":"  "}', "empty_required"), ('{"city":"x"}', None), (None, "invalid_json"),
    ],
)
def test_argument_error(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string")
    assert df.select(columns.argument_error(F.col("a"), ["city"]).alias("e")).first().e == want


def test_tools(spark):
    rows = spark.createDataFrame([("1", "a", 5), ("1", "b", 6)], "x string, y string, n int")
    known = [tools.TableTool("one", "by x and y", ("x", "y"), rows), tools.TableTool("all", "no arguments", (), rows.limit(1).select("n"))]
    listed = {r.name: json.loads(r.definition) for r in tools.tool_listing(spark, known).collect()}
    assert listed["one"]["input_schema"] == {"type": "object", "properties": {"x": {"type": "string"}, "y": {"type": "string"}}, "required": ["x", "y"]} and listed["all"]["input_schema"]["required"] == []
    given = [(1, "one", '{"x": "1", "y": "b", "z": 3}'), (2, "one", '{"x": "2", "y": "b"}'), (3, "none", '{"x": "1"}'), (4, "one", None), (5, None, "{}"), (6, "one", '{"x": "1"}'), (7, "all", "{}"), (7, "all", "{}"), (8, "one", '{"x": 1, "y": "b"}'), (9, "all", "[]")]
    calls = spark.createDataFrame(given, "id int, tool string, arguments string").withColumn("data_", F.lit(0))
    out = tools.call_tools(calls, known)
    assert out.columns == [*calls.columns, "result"]
    got = sorted(((r.id, r.result.ok, r.result.data, r.result.error) for r in out.collect()), key=repr)
    assert got == [
        (1, True, '{"n":6}', None), (2, False, None, "tool_failed"), (3, False, None, "unknown_tool"), (4, False, None, "invalid_json"), (5, False, None, "unknown_tool"), (6, False, None, "missing_required"),
        (7, True, '{"n":5}', None), (7, True, '{"n":5}', None), (8, False, None, "invalid_type"), (9, False, None, "arguments_must_be_object"),
    ]


def test_fingerprints(spark):
    rows = [('{"b": 1, "a": {"d": 2, "c": "x  y"}}',), (' {"a":{"c":"x  y","d":2},"b":1}',), (" bad { ",)]
    got = [r.f for r in spark.createDataFrame(rows, "a string").select(columns.action_fingerprint(F.lit("t"), F.col("a")).alias("f")).collect()]
    assert got == ['t:{"a":{"c":"x  y","d":2},"b":1}'] * 2 + ["t:bad {"]


def test_hooks_fail_closed(spark):
    df = spark.createDataFrame([(1, 50.0), (2, 90.0)], "id int, score double")
    step = lambda d: d.withColumn("twice", F.col("score") * 2)
    out = tools.with_hooks(df, step, [tools.Hook(2, block=F.when(F.col("score") > 60, "high")), tools.Hook(1, inputs={"score": F.col("score") + 20})])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 70.0, None, "high"), (2, 110.0, None, "high")]
    with pytest.raises(Exception):
        tools.with_hooks(df, step, [tools.Hook(1, block=F.raise_error(F.lit("broken")).cast("string"))]).collect()


def test_compression():
    assert messages.compress_value({"a": "x" * 200, "b": [1, 2, 3, 4]}) == {"a": "x" * 100 + "...", "b": [1, 2, 3]}


@pytest.mark.parametrize("text", ["", "short", "a b " * 400, "x" * 1300, "p\n\nq " * 300])
def test_chunks_cover(text):
    parts = chunks.pack_recursive(text)
    assert "".join(parts) == text and all(len(p) <= 512 for p in parts)


def test_structured_chunks():
    table = "|a|b|\n|-|-|\n" + "\n".join(f"|{i}|{i}|" for i in range(200))
    parts = chunks.split_structured(f"intro\n{table}\n```\ncode | x\n```\nend", 300)
    assert sum(p.startswith("|a|b|\n|-|-|") for p in parts) > 1 and "```\ncode | x\n```" in parts
    assert chunks.split_python("def f():\n    return 1\n\nclass A:\n    x = 2\n") == ["def f():\n    return 1", "class A:\n    x = 2"]


def test_title_paths(spark):
    df = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\nz\n### D\nw")], "doc_id long, text string")
    got = {r.line: r.path for r in chunks.title_paths(df).collect()}
    assert (got["x"], got["y"], got["z"], got["w"]) == ("A", "A > B", "C", "C > D")


def test_rates():
    assert rates.answers(rates.sliding(2, 10), [0, 1, 2, 11]) == [True, True, False, True]
    assert rates.answers(rates.sliding(2, 10), [0, 1, 2, 10.5]) == [True, True, False, True]
    assert rates.answers(rates.token_bucket(2, 1), [0, 0, 0, 1]) == [True, True, False, True]
    assert rates.answers(rates.leaky_bucket(2, 1), [0, 0, 0, 1]) == [True, True, False, True]
    assert rates.answers(rates.bucket_waits(2, 1), [0, 0, 0, 0, 10]) == [0, 0, 1, 2, 0]


def test_fold_over_many_batches(spark):
    """Keys that reach over batches, null keys, and an empty table."""
    rows = spark.range(20000).select((F.col("id") % 3).alias("k"), "id").unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k long, id long"))
    count = lambda df: {r.k: (r.n, r.last) for r in folds.fold(df, "k", ["id"], lambda: (0, None), lambda s, r: ((s[0] + 1, r["id"]), []), lambda k, s: [(k, *s)], "k long, n long, last long").collect()}
    assert count(rows) == {0: (6667, 19998), 1: (6667, 19999), 2: (6666, 19997), None: (2, 2)}
    assert count(rows.limit(0)) == {}


def test_stream_assembly(spark, sf_dir):
    got = {r.stream_id: r for r in procedures.stream_assemble(spark, sf_dir).collect()}
    assert got["s1"].status == "completed" and json.loads(json.loads(got["s1"].arguments)["c1"]) == {"city": "Shanghai"}
    errors = {k: r.error for k, r in got.items()}
    assert errors == {"s1": None, "s2": "no_completion", "s3": "after_terminal", "s4": "unknown_type", "s5": "missing_call_id", "s6": "response_error"}


def test_minhash_classes(spark):
    """Every link counts: near texts of which the least id's bucket mate is not one, chains, copies, and short texts."""
    w = [f"w{i}" for i in range(100)]
    text = lambda *gone: " ".join("z" + x if i in gone else x for i, x in enumerate(w))
    rows = [(1, text(0)), (2, text(0, 99)), (3, text(99)), (4, "other words only here"), (5, "other  WORDS only here"), (6, None), (7, ""), (8, text(50)), (None, text(0))]
    got = {r.id: r.class_id for r in similar.minhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 4: 4, 5: 4}


def test_bucket_links_connect_all(spark):
    """Of a bucket that holds two groups and odd ones, all links are found by whichever member has them."""
    values = {1: 0, 2: 10, 3: 1, 4: 11, 5: 2, 6: 12, 7: 50, 8: 3}
    members = spark.createDataFrame([(b, i) for b in (0, 1) for i in values if b == 0 or i < 4], "bucket long, id long")
    items = spark.createDataFrame(list(values.items()), "id long, payload long")
    links = similar.bucket_links(members, items, F.abs(F.col("pa") - F.col("pb")) <= 1)
    got = {r.node: r.root for r in components.connected_components(links, "a", "b").collect()}
    assert got == {3: 1, 5: 1, 8: 1, 4: 2, 6: 2}


def test_cosine_recall(spark, sf_dir):
    """All pairs above 0.85 by brute force are found, and labels do not matter."""
    import numpy as np

    moved = procedures._moved(spark, sf_dir)
    rows = sorted((r.id, tuple(r.v)) for r in moved.collect())
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(v @ v.T > 0.85, 1)))}
    got = {(r.a, r.b) for r in similar.cosine_links(moved, "id", "v", 0.85)[0].collect()}
    assert len(want) > 5 and got <= want and len(got) >= 0.98 * len(want)


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("f", "e"), ("x", "y"), ("y", "x"), ("y", "z"), ("a", "z")], "u string, v string")
    assert {r.node: r.wave for r in walks.waves(edges, "u", "v").collect()} == {"a": 0, "f": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)] + [(100, 101), (101, 100), (102, 100), (200, 999)], "id long, up long")
    assert {r.node: r.length for r in walks.chain_lengths(chain, "id", "up").collect()} == {i: i for i in range(70)} | {200: 0}
    calls = spark.createDataFrame([(1, None, "A"), (2, 1, "B"), (3, 2, "A"), (4, 3, "C"), (5, 4, "B")], "id long, up long, agent string")
    assert {r.call: r.distance for r in walks.repeated_callers(calls, "id", "up", "agent").collect()} == {3: 2, 5: 3}
    deep = spark.createDataFrame([(i, i - 1 if i else None, "A" if i in (0, 12) else f"x{i}") for i in range(13)], "id long, up long, agent string")
    assert [tuple(r) for r in walks.repeated_callers(deep, "id", "up", "agent").collect()] == [(12, 12)]


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.n == r.k + 1 for r in tables.numbered(rows, ["k"], "n").collect())


def test_files(spark, tmp_path):
    (tmp_path / "topic.md").write_text("# T\n## Q： one?\n> 来源: book\n**新手答**: \"short\"\n**高手答**:\nlong\nanswer\n**差距在哪**: depth\nof it\n---\n### Q: two?\n\n## other\n", encoding="utf-8")
    (tmp_path / "skill.md").write_text("---\nname: s\ndescription: d\n---\nbody\n")
    texts = files.read_texts(spark, str(tmp_path))
    sections = files.question_sections(texts.where("path like '%topic.md'"))
    assert [r["index"] for r in sections.orderBy("index").collect()] == [1, 2]
    (got,) = files.question_fields(sections).collect()
    assert tuple(got) == ("topic:1", "topic", "one?", "book", "short", "long\nanswer", "depth\nof it")
    assert files.front_matter(texts.where("path like '%skill.md'")).first()["name"] == "s"
    for _ in range(2):  # a new trace begins empty
        trace = files.Trace(spark, f"{tmp_path}/trace")
        trace.record(spark.createDataFrame([(1, {"api_key": "abc"})], "id int, payload map<string,string>"), "e")
    trace.record(spark.createDataFrame([(2, "Bearer abc")], "id int, note string"), "f")
    assert sorted(r.value for r in spark.read.text(trace.path).collect()) == ['{"event":"e","id":1,"payload":{"api_key":"[REDACTED]"}}', '{"event":"f","id":2,"note":"Bearer [REDACTED]"}']
    assert files.write_file(spark, f"{tmp_path}/note.txt", "héllo") == 6 and (tmp_path / "note.txt").read_text() == "héllo"
    assert {r.path.rsplit("/")[-1] for r in files.list_dir(spark, str(tmp_path), "*.md").collect()} == {"topic.md", "skill.md"}


def test_missed_changes(spark):
    old, new = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a"), (2, "b"), (3, "c")], [(2, "b"), (3, "x"), (4, None)]))
    assert {r.k: r.action for r in files.missed_changes(new, old, "k").collect()} == {1: "delete", 3: "update", 4: "insert"}


def test_plans(spark):
    df = spark.createDataFrame([(1, 50.0), (2, 90.0)], "id int, score double")
    graph = StateGraph().node("start", seen=F.lit(True)).node("low", advice=F.lit("again")).node("high", advice=F.lit("done"))
    graph.edge("start", "low", F.col("score") < 60).edge("start", "high", F.col("score") >= 60)
    assert {r.id: r.advice for r in graph.compile("start")(df).collect()} == {1: "again", 2: "done"}
    with pytest.raises(ValueError):
        StateGraph().node("a").node("b").edge("a", "b").edge("b", "a").order()
    with pytest.raises(ValueError):
        Registry().register("x", lambda d: d).register("x", lambda d: d)
    assert loop_until(df, lambda d: d.withColumn("score", F.col("score") + 10), lambda d: d.agg(F.min("score")).first()[0] >= 75).agg(F.min("score")).first()[0] == 80


def test_packed_numbers():
    for numbers in ([], [0], [127, 128, 0, 16383, 16384, 1 << 40], list(range(1000))):
        assert search.unpack(search.pack(numbers)).tolist() == numbers


def test_search_awkward_and_skipping(spark, tmp_path):
    """Null, empty, repeated and sparse ids and texts, several cells; few blocks are read for a rare word, and a frequent word is many rows."""
    rows = [(i * 1000003, f"common words w{i % 7} " + ("needle needle" if i in (40, 4000) else "hay")) for i in range(6000)] + [(None, "common needle"), (5, None), (6, ""), (7, "twice"), (7, "twice"), (8, "ÉTÉ été\tcommon " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = search.build_index(docs, f"file://{tmp_path}/i", cell=64)
    asked = spark.createDataFrame([(1, "needle"), (2, "common needle common"), (3, "unknown"), (4, None), (5, "été w3"), (6, "twice")], "q long, text string")
    got = {}
    for r in sorted(search.search(index, asked, "q", "text", 3).collect(), key=lambda r: (r.q, r["rank"])):
        got.setdefault(r.q, []).append(r.id)
    assert got[1][:2] == [40 * 1000003, 4000 * 1000003] and None in got[1] and got[2] == got[1] and got[5][0] == 8 and got[6] == [7, 7] and set(got) == {1, 2, 5, 6}
    report = {r.q: (r.blocks, r.read) for r in search.search_report(index, asked, "q", "text", 3).collect()}
    assert report[1][0] <= 3 and report[2][0] > 90 and report[2][1] < report[2][0] / 3
    words = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    assert {(r.q, r.id) for r in search.match_all(index, asked, "q", words).collect()} == {(1, 40 * 1000003), (1, 4000 * 1000003), (1, None), (2, 40 * 1000003), (2, 4000 * 1000003), (2, None), (6, 7)}
    empty = search.build_index(docs.limit(0), f"file://{tmp_path}/e")
    assert search.search(empty, asked, "q", "text").count() == 0 and search.match_all(empty, asked, "q", words).count() == 0


def test_vector_search(spark, tmp_path):
    """Clustered vectors, a third of them alike, nulls, repeated ids and labels: the bounded search is exact, and a tenth of the cells finds 0.9."""
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 13))
    rows = [(i, (centres[i % 40] + 0.2 * rng.normal(size=13)).tolist(), i % 3) for i in range(1200)] + [(5000 + i, (centres[7] + 1e-3 * rng.normal(size=13)).tolist(), None) for i in range(600)]
    table = spark.createDataFrame([*rows, (1, rows[1][1], 2), (None, rows[2][1], 1), (9999, None, 1)], "id long, v array<double>, label int").repartition(5)
    index = vectors.build_vectors(table, f"file://{tmp_path}/v", "id", "v", "label", list_rows=100)
    sizes = [r["size"] for r in spark.read.parquet(f"{tmp_path}/v/lists").collect()]
    assert sum(sizes) == 1801 and max(sizes) <= 100
    asked = spark.createDataFrame([(i, rows[i][1], [None, 2][i % 2]) for i in range(0, 1200, 50)] + [(7777, None, None), (8888, rows[3][1], 77)], "q long, v array<double>, wanted int")
    ids, v, labels = np.array([r[0] for r in [*rows, (1,)]]), np.array([r[1] for r in [*rows, rows[1]]]), np.array([-1 if r[2] is None else r[2] for r in rows] + [2])

    def plain(q, wanted, skip):
        scores = np.round(v @ np.array(rows[q][1]), 5)
        able = [(-s, i) for s, i, x in zip(scores, ids, labels) if (wanted is None or x == wanted) and not (skip and i == q)]
        return [int(i) for _, i in sorted(able)[:10]]

    def found(**more):
        out = {}
        for r in sorted(vectors.search_vectors(index, asked, "q", "v", 10, **more).collect(), key=lambda r: (r.q, r["rank"])):
            out.setdefault(r.q, []).append(r.id)
        return out

    assert found(exact=True) == {q: plain(q, None, False) for q in [*range(0, 1200, 50)]} | {8888: found(exact=True)[8888]}
    assert found(exact=True, skip_self=True, label="wanted") == {q: plain(q, [None, 2][q % 2], True) for q in range(0, 1200, 50)}
    near_ = found(probe_share=0.1)
    assert sum(len(set(near_[q]) & set(plain(q, None, False))) for q in range(0, 1200, 50)) >= 0.9 * 240
    empty = vectors.build_vectors(table.limit(0), f"file://{tmp_path}/e", "id", "v")
    assert vectors.search_vectors(empty, asked, "q", "v").count() == 0


def test_vector_recall(spark, tmp_path):
    """Vectors without clusters: 0.9 of the ten nearest, against all of them by hand."""
    import numpy as np

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    v = np.array([r.embedding for r in rows], np.float64)
    want = {(r.vec_id, rows[j].vec_id) for i, r in enumerate(rows) if r.vec_id % 50 == 0 for j in np.argsort(-(v @ v[i]))[:10]}
    index = vectors.build_vectors(table, f"file://{tmp_path}/v", "vec_id", "embedding")
    got = {(r.vec_id, r.id) for r in vectors.search_vectors(index, table.where("vec_id % 50 = 0"), "vec_id", "embedding").collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_dbscan_marks_border_and_noise(spark):
    """Dense, thin, bordering and lone vectors, copies and nulls, against a plain DBSCAN."""
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(i, (np.eye(16)[i % 3] + 0.12 * rng.normal(size=16)).tolist()) for i in range(90)] + [(100 + i, (np.eye(16)[5] + 0.004 * rng.normal(size=16)).tolist()) for i in range(60)] + [(200 + i, rng.normal(size=16).tolist()) for i in range(40)]
    rows += [(300 + i, rows[-1][1]) for i in range(3)] + [(400, (np.eye(16)[5] + 0.55 * np.eye(16)[9]).tolist())]
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids, close = [i for i, _ in rows], v @ v.T >= 0.86
    core = close.sum(1) >= 4
    label = {i: i for i in range(len(rows)) if core[i]}
    while True:
        new = {i: min(label[j] for j in label if close[i, j]) for i in label}
        if new == label:
            break
        label = new
    want = {}
    for i, name in enumerate(ids):
        near_ = [label[j] for j in label if close[i, j]]
        want[name] = (ids[label[i]], "core") if core[i] else (ids[min(near_)], "border") if near_ else (None, "noise")
    table = spark.createDataFrame([*rows, (None, rows[0][1]), (999, None)], "id long, v array<double>")
    got = {r.id: (r.class_id, r.kind) for r in similar.dbscan(table, "id", "v", 0.86, 4).collect()}
    assert got == want and {k for _, k in want.values()} == {"core", "border", "noise"}


def test_buckets_of_any_size(spark):
    """One bucket of many unlike items and a group of copies takes two rounds, in chunk pairs; all links are found."""
    values = {i: i * 10 for i in range(1500)} | {10000 + i: 3 for i in range(1500)} | {20000: 7504, 20001: 7505}
    members, items = spark.createDataFrame([(1, i) for i in values], "bucket long, id long"), spark.createDataFrame(list(values.items()), "id long, payload long")
    links = similar.bucket_links(members, items, F.abs(F.col("pa") - F.col("pb")) <= 3)
    got = {r.node: r.root for r in components.connected_components(links, "a", "b").collect()}
    assert got == {10000 + i: 0 for i in range(1500)} | {20001: 20000}
    pairs = similar.bucket_pairs(members.where("id < 300").withColumnRenamed("id", "x"), members.where("id < 200").withColumnRenamed("id", "y"), chunk=16)
    assert pairs.count() == 300 * 200 == pairs.distinct().count()


def test_simhash_chunk_recall(spark):
    """Pairs of chunks by brute force: 0.9 or more of those above 0.85 share a class, and no others do."""
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts = sorted({line for t in rows for line in (t or "").split("\n") if len(line.split()) > 8})[:1500]
    texts += [t.replace(t.split()[4], "changed", 1) for t in texts[::5] if len(t.split()) > 30]
    sets = [{tuple(t.lower().split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    want = {(i, j) for own in by.values() for i in own for j in own if i < j and len(own) < 400 and len(sets[i] & sets[j]) > 0.85 * len(sets[i] | sets[j])}
    import hashlib

    got = {r.text_hash: r.class_id for r in similar.simhash_chunks(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    names = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    assert len(want) > 20 and sum(got[names[i]] == got[names[j]] for i, j in want) >= 0.99 * len(want)


def test_merge_table(spark, tmp_path, monkeypatch):
    """A batch writes its own rows, replays and late records change nothing, only touched buckets are rewritten, and a lost race is an error."""
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / "t" / name).rglob("*.parquet"))
    table = merge_table.MergeTable(spark, f"file://{tmp_path}/t", "k", "at", 8)
    with pytest.raises(FileNotFoundError):
        table.read()
    schema = "op string, k long, at long, v string"
    table.apply(spark.range(20000).select(F.lit("upsert").alias("op"), F.col("id").alias("k"), F.lit(0).cast("long").alias("at"), F.md5(F.col("id").cast("string")).alias("v")), 0)
    table.compact()
    base = table.manifest()["base"]
    table.apply(spark.createDataFrame([("upsert", 5, 2, "new"), ("upsert", 5, 1, "old"), ("delete", 7, 3, None), ("upsert", None, 1, "no key"), ("upsert", 50000, 1, "more")], schema), 1)
    table.apply(spark.createDataFrame([("upsert", 5, 9, "told twice")], schema), 1)
    table.apply(spark.createDataFrame([("upsert", 7, 2, "late"), ("upsert", 6, 4, "six")], schema), 2)
    first, small = table.manifest()["deltas"][0]["name"], size(table.manifest()["deltas"][0]["name"])
    assert first.startswith("delta-1") and small * 20 < size(base["0"])

    def check():
        rows = {r.k: r.v for r in table.read().where("k < 10 OR k > 19999").collect()}
        assert rows[5] == "new" and rows[6] == "six" and rows[50000] == "more" and 7 not in rows and len(rows) == 10 and table.read().count() == 20000

    check()
    table.compact()
    check()
    now = table.manifest()
    assert now["deltas"] == [] and 0 < sum(now["base"][b] != base[b] for b in base) < 8
    table.apply(spark.createDataFrame([("upsert", 7, 1, "older than its delete")], schema), 3)
    table.apply(spark.createDataFrame([], schema), 4)
    table.clean()
    check()
    with pytest.raises(RuntimeError):
        table._swap(table.manifest())
    monkeypatch.setattr(merge_table, "MOST_DELTAS", 1)
    table.apply(spark.createDataFrame([("upsert", 5, 10, "newest")], schema), 5)
    assert len(table.manifest()["deltas"]) == 1 and table.read().where("k = 5").first().v == "newest"


def test_interval_join(spark):
    """Spans of every length, points at their bounds, a hot second, nulls and empty sides, against all pairs by hand."""
    import random

    rnd = random.Random(1)
    assert all(sum(1 << level for level, _ in intervals.dyadic_cells(a, b)) == b - a + 1 and len(intervals.dyadic_cells(a, b)) <= 2 * (b - a + 1).bit_length() for a in range(0, 40) for b in range(a, 80))
    spans = [(i, a, a + rnd.choice([0, 3, 50, 100000, 1 << 40])) for i, a in enumerate(rnd.choices(range(1000), k=80))] + [(900, 5, 4), (901, None, 4), (902, 1, None)]
    segments = [(i, a, a + rnd.choice([0, 1, 60])) for i, a in enumerate(rnd.choices(range(1200), k=300))] + [(1000 + i, 500, 500) for i in range(300)] + [(5000, None, 3), (5001, 3, None)]
    left, right = spark.createDataFrame(spans, "id long, low long, high long"), spark.createDataFrame(segments, "segment long, start long, stop long")
    want = {(i, s) for i, a, b in spans if a is not None and b is not None for s, x, y in segments if x is not None and y is not None and a <= x <= b and y <= b}
    got = [(r.id, r.segment) for r in intervals.contained(left, right, chunk=32).collect()]
    assert set(got) == want and len(got) == len(want)
    assert intervals.contained(left.limit(0), right).count() == 0 and intervals.contained(left, right.limit(0)).count() == 0


def test_run_share(spark):
    """Items shorter than a run are sought whole; repeated runs count once; nulls and wordless items are in nothing."""
    long = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, "a b c d e f g h i j zz"), (3, "only three words here"), (4, None), (5, "a b c d e f g h")], "d long, t string")
    items = spark.createDataFrame([(1, long.upper()), (2, "Three  words"), (3, None), (4, ""), (5, "a b c d e f g h a b c d e f g h")], "i long, t string")
    got = {(r.d, r.i): round(r.share, 3) for r in leaks.run_share(docs, items, "d", "t", "i", "t").collect()}
    assert got == {(1, 1): 1.0, (2, 1): 0.6, (3, 2): 1.0}
    assert leaks.run_share(docs, items.where("i = 3"), "d", "t", "i", "t").count() == 0


def test_clean_pages(spark):
    """Navigation, adverts on many pages, scripts and comments go; a page's own text stays, in order and without signs of HTML."""
    page = lambda n: f"<!DOCTYPE html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home of all our pages</a></li></ul></nav><!-- ad --><div class=ad>Buy our very best things now</div><p>Own text number {n} is here &amp; <b>there</b>.<script>var x = '</p>'</script><p>Second <a href='/x'>link</a> of four{n} words</p><footer>ok</footer></body>"
    rows = [(n, f"http://A.example/{n}", page(n)) for n in range(4)] + [(10, "http://b.example/", page(10)), (11, None, None), (12, "x", "plain text without a tag"), (12, "x", "and another row of it")]
    got = {r.page_id: (r.kept, r.dropped, r.text) for r in pages.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == (2, 3, "Own text number 1 is here & there .\nSecond link of four1 words") and got[10][2].startswith("Buy our very best things now\nOwn text") and got[11] == (0, 0, "")
    assert got[12][0] == 2 and set(got) == {0, 1, 2, 3, 10, 11, 12}


def test_loop_until_says_when_it_is_not_done(spark):
    df = spark.createDataFrame([(1,)], "n int")
    with pytest.raises(RuntimeError):
        loop_until(df, lambda d: d.withColumn("n", F.col("n") + 1), lambda d: d.where("n < 100").isEmpty(), 3)
