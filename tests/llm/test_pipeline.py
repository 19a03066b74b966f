"""The pipeline, stage by stage, against plain versions."""

import re

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from tests.llm.test_operators import AWKWARD, SCHEMA, order, plain_groups, plain_tokens, words

from quarrystone.llm import common, decontaminate, mixing, registry, toxicity
from quarrystone.operators.tables import fresh_dir


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        seen[name] = docs, (docs := spark.read.parquet(path))
    model = toxicity.train(seen["toxicity"][0], spark.read.parquet(f"{sf_dir}/labels.parquet"), registry.LEARN)
    keep = toxicity.score_texts(seen["toxicity"][0], model).where("predicted = 0")
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    assert [r[0] for r in rows(seen["toxicity"][1])] == sorted(r.doc_id for r in keep.collect())
    before, after = seen["simhash near-dedup"]
    assert [r[0] for r in rows(after)] == sorted(a for a, _, least in plain_groups(rows(before)) if a == least)
    before, after = seen["decontamination"]
    leaked = {r.doc_id for r in decontaminate.benchmark_leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert [r[0] for r in rows(after)] == [r[0] for r in rows(before) if r[0] not in leaked]
    before, after = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix_counts(before).collect()}
    assert [r[0] for r in rows(after)] == sorted(k for k, n in copies.items() for _ in range(n))
    before, after = seen["token output"]
    assert order(after.collect()) == order(plain_tokens(rows(before)))
    assert all(df.columns == columns for name, (_, df) in seen.items() if name != "token output")


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_awkward_rows(spark):
    """Null, empty, long and repeated rows pass every stage; of a group of copies one stays, and texts without words end at the mix."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(AWKWARD, SCHEMA).withColumn("row", F.lit("r")).withColumn("mark", F.lit("m")).withColumn("times", F.lit(0))
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        assert name == "token output" or after.columns == docs.columns
        docs, counts[name] = after, sorted((r.doc_id for r in after.collect()), key=repr)
    copies = [r for r, _, least in plain_groups([r[:2] for r in AWKWARD]) if r == least or least is None]
    assert counts["toxicity"] == sorted((r[0] for r in AWKWARD), key=repr)
    assert counts["simhash near-dedup"] == counts["decontamination"] == sorted(set(copies), key=repr)
    assert set(counts["mixing"]) <= {r[0] for r in AWKWARD if words(r[1])} and counts["token output"] == counts["mixing"]


def test_stages_hand_over_small_batches(spark):
    """After a stage was made, tasks give Python a few MB of text at a time, not 10,000 rows."""
    session, sf_dir = spark, "/root/testdata/sf0.001"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.token_output):
        session = session.newSession()
        stage(session, session.read.parquet(f"{sf_dir}/documents.parquet").limit(20), sf_dir)
        found = session.range(0, 10_000, 1, 1).select(F.repeat(F.lit("word "), 600).alias("text")).mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in found) == 10_000
        assert max(r.bytes for r in found) < 5 << 20
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    common.small_batches(session)
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


def test_workers_give_memory_back():
    """What a task has freed is not held by its worker when the last piece was read."""

    def held():
        return int(re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    own = common.pieces([batch], "text")
    next(own)
    texts = [bytes([1]) * 3000 for _ in range(40_000)]
    last = texts[-1]  # else the allocator gives back the end of its heap by itself
    texts = None
    before = held()
    assert next(own, None) is None
    assert held() < before - 80 and last
