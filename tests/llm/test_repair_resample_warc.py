"""Conversation repair, importance resampling and WARC archives against plain versions, and on awkward rows."""

import base64
import collections
import functools
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import conversations, registry, resample, warc

# --- conversation repair

CHATS = "conv_id long, turn long, role string, text string, audit string, position int, named long"


def plain_cheapest(letters):
    """(cost, edits) over suffixes, by trying every edit at every place."""

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(letters) and state in ("", "a") else []
        new = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 3:
            cost, rest = best(i, new, inserted + 1)
            found.append((cost + 2, "I" + rest))
        if i < len(letters):
            late, role = letters[i].isupper(), letters[i].lower()
            cost, rest = best(i + 1, state, 0)
            found.append((cost + 3, "D" + rest))
            if role != "x":
                cost, rest = best(i + 1, new, 0)
                found.append((cost + 2 + late, "R" + rest))
                if role == new or (role == "s" and state == ""):
                    cost, rest = best(i + 1, role, 0)
                    found.append((cost + late, "K" + rest))
        return min(found, default=(math.inf, ""))

    for i in range(len(letters), -1, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def plain_repair(rows):
    """What op11 returns for the rows (conv_id, turn, role, text)."""
    space, out = "\x20\x09\x0a\x0b\x0c\x0d", {}
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        by_conv[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for conv, found in by_conv.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        faults, seen, letters = [], set(), ""
        for _, role, text in found:
            body = text.rstrip(space)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "fine"
            seen.add((role, text))
            faults.append(fault)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault == "truncated" else letter
        cost, audit = plain_cheapest(letters)
        left, repaired, state = iter(found), [], ""
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit == "D":
                continue
            state = role[0] if edit == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            repaired.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        count = collections.Counter(faults)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def repaired(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op11_against_brute_force(spark, size):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(registry.op11_conversations(spark, f"/root/testdata/{size}")) == plain_repair(rows)


def test_trie_answers_are_the_cheapest_and_least():
    every = sorted("".join(p) for n in range(5) for p in itertools.product("suaoxSUA", repeat=n))
    rng = random.Random(3)
    long = sorted({"".join(rng.choices("suaoxSUAO", [1, 6, 6, 1, 2, 1, 2, 2, 1], k=rng.randrange(5, 60))) for _ in range(300)})
    for batch in (every, long):
        assert list(conversations.answers(batch)) == [plain_cheapest(s) for s in batch]


def test_layers_are_few_and_shared():
    conversations.advance.cache_clear()
    rng = random.Random(5)
    found = list(conversations.answers(sorted("".join(rng.choices("suaoxSUAO", k=400)) for _ in range(50))))
    assert all(len(edits) - edits.count("I") == 400 for _, edits in found)
    known = conversations.advance.cache_info()
    assert known.misses < 1000 and known.hits + known.misses <= 50 * 400


def test_repair_awkward(spark, tmp_path):
    rows = [
        (None, 1, "user", "A question?"), (None, 2, "assistant", "An answer."),  # a null id is an id
        (1, None, "system", "Be brief."), (1, None, None, None), (1, 1, "user", "Hello."), (1, 1, "user", "Hello."), (1, 5, "tool", "12"),
        (2, 1, "", "no role."), (2, 2, "User", "other case."), (3, 1, None, "x" * 300000 + "."), (3, 2, "assistant", " \t\n\r\x0b\f"), (3, 3, "assistant", "\x1c.\x85"),
        (4, 7, "assistant", "No question."), (5, 1, "user", "a:b."), (5, 2, "user:a", "b."), (6, None, "user", "only null turns."), (6, None, "user", "and two."),
        *[(7, t, "user" if t % 2 else "assistant", f"turn {t}." if t % 3 else "same.") for t in range(1000)],
    ]
    path = tmp_path / "c"
    spark.createDataFrame([(*r, "no", 1, 2) for r in rows], CHATS).write.parquet(f"{path}/conversations.parquet")
    want = plain_repair(rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(registry.op11_conversations(spark, str(path))) == {c: want[c] if c in want and want[c][6] else nothing for c in {r[0] for r in rows}}
    spark.createDataFrame([], CHATS).write.parquet(f"{path}/empty/conversations.parquet")
    assert registry.op11_conversations(spark, f"{path}/empty").count() == 0


def test_repaired_turns_read_well(spark, sf_dir):
    rows = conversations.damage_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    solved, turns = conversations.repair_conversations(rows)
    spoken = collections.defaultdict(str)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.position)):
        spoken[r.conv_id] += r.role[0]
    assert spoken and all(re.fullmatch("(s?(ua)+)?", s) for s in spoken.values())
    assert {r.conv_id for r in solved.collect()} >= set(spoken)


# --- importance resampling


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    buckets = lambda text: [zlib.crc32(f.encode()) % 10000 for f in plain_features(text)[1]]
    s, t = (collections.Counter(b for text in side for b in buckets(text)) for side in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for doc_id, text in docs:
        weight, h = sum(map(gain, buckets(text))), int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, plain_features(text)[0], len(buckets(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0], r[3], r[2]))
    rank = {}
    for n, r in enumerate(able[: len(able) * 5 // 100], 1):
        rank.setdefault(r, []).append(n)
    return sorted([(r[0], *r[2:], rank[r].pop() if rank.get(r) and r[1] >= 20 else None) for r in rows], key=repr)


def test_op12_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = registry.op12_resample(spark, sf_dir)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_resample(docs, target)


def test_ring_equals_whole_runs(monkeypatch):
    monkeypatch.setattr(resample, "_SLICE", 7)
    monkeypatch.setattr(resample, "_HELD", 5)
    for text in ("", " ", "one", "Two words", "ÀB c'd é—f g_h 12 \x00x\x7fy 日本 語", "a b c d e f g h i j k l m n o p " * 9):
        for run in (1, 2, 3, 5):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
            want = [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, run + 1) for i in range(len(w) - n + 1)]
            got = [int(h) for part in resample.feature_hashes(text.encode(), run) for h in part]
            assert sorted(got) == sorted(want)
            assert resample.word_count(len(got), run) == len(w)


def test_resample_awkward(spark, tmp_path):
    long = "Word by word, a text without end. " * 9000
    rows = [(1, None), (2, ""), (None, "no id " * 30), (3, " \x00\t"), (4, long), (4, long), (5, long), (5, "other words of the same id " * 9), *[(n, f"text {n} that says little and goes on for as long as it takes to be drawn by the rule of twenty words or so") for n in range(6, 80)]]
    docs = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], "doc_id long, text string, rank int, bucket string, weight double")
    target = spark.createDataFrame([("a text without end",), (None,), ("",)], "text string")
    got = resample.resample_ranks(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_resample(rows, ["a text without end", None, ""])
    none = docs.limit(0)
    assert resample.resample_ranks(none, target).count() == 0
    assert sorted(resample.resample_ranks(docs, target.limit(0)).select(*got.columns).collect(), key=repr) == plain_resample(rows, [])
    drawn = resample.draw_documents(docs.where("doc_id > 5"), target, percent=20)
    assert drawn.columns == docs.columns and drawn.count() == 74 * 20 // 100


def test_draw_prefers_the_target(spark):
    rng = random.Random(8)
    text = lambda kind: " ".join(rng.choice(kind) for _ in range(40))
    maths, chat = [f"theorem{i}" for i in range(30)], [f"gossip{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, text(maths if i % 4 == 0 else chat)) for i in range(800)], "doc_id long, text string")
    drawn = resample.draw_documents(docs, spark.createDataFrame([(text(maths),) for _ in range(20)], "text string"))
    assert drawn.count() == 40 and drawn.where("doc_id % 4 = 0").count() == 40


# --- WARC

PAGES = "page_id long, url string, html string, size int, sha1 string, copies long, chunk string"


def plain_warc(rows, least=0):
    first, out = {}, []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        one = (page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        if len(raw) >= least and raw in first:
            out.append((*one, "revisit", first[raw]))
        else:
            first[raw] = page
            out.append((*one, "response", None))
    return sorted(out, key=repr)


def pages(spark):
    rows = [
        (1, "http://a/", "<p>one</p>"), (2, None, None), (3, "http://c/", ""), (4, "http://d/\r\nX: é ü", "é" * 5000), (5, "http://e/", "<p>one</p>"), (None, "http://f/", "<p>one</p>"),
        (6, "http://g/", "same row"), (6, "http://g/", "same row"), (6, "http://g/", "same row"), (6, "http://h/", "same row"), (7, "http://i/", "WARC/1.1\r\n\r\n" * 400000), (8, "http://i/", "WARC/1.1\r\n\r\n" * 400000),
        (9, "http://j/", "\r\n"), (10, "http://k/", "\x00\x01"), *[(n, "http://hot/", "hot page") for n in range(100, 9000)], *[(20, "http://l/", "often")] * 9000,
    ]
    return rows, spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], PAGES)


@pytest.mark.parametrize("more", [{}, {"compress": False, "chunk": 1000, "roll": 20000}, {"least": 9, "chunk": 64}, {"least": 1 << 30}])
def test_warc_against_brute_force(spark, more):
    rows, frame = pages(spark)
    if more.get("chunk") == 64:
        rows, frame = [r for r in rows if len(r[2] or "") < 10000], frame.where("html IS NULL OR length(html) < 10000")
    got = warc.warc_round_trip(frame, **more)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_warc(rows, more.get("least", 0))


def test_warc_empty(spark):
    _, frame = pages(spark)
    assert warc.warc_round_trip(frame.limit(0)).count() == 0


def test_warc_revisits_by_shuffle(spark, monkeypatch):
    from quarrystone.operators import tables

    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    rows, frame = pages(spark)
    assert sorted([tuple(r) for r in warc.warc_round_trip(frame).collect()], key=repr) == plain_warc(rows)


def test_files_are_warc_and_chunks_join(spark, tmp_path):
    rows, frame = pages(spark)
    frame = frame.where("page_id < 20")
    manifest = warc.write_warc(frame, f"file://{tmp_path}", chunk=1 << 16, roll=1 << 16)
    files = sorted(tmp_path.iterdir())
    assert sorted(r.uri for r in manifest.collect()) == sorted(f"file://{p}" for p in files) and len(files) > 1
    records = 0
    for file in files:
        raw = gzip.decompress(file.read_bytes())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            assert {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date"} <= set(fields)
            records += fields[b"WARC-Type"] != b"warcinfo"
            raw = rest[size + 4 :]
    assert records == frame.count() == manifest.agg(F.sum("records")).first()[0]
    chunks = warc.read_warc(manifest, chunk=1 << 16).where("record_type = 'response'")
    assert chunks.agg(F.max(F.octet_length("chunk"))).first()[0] <= 1 << 16
    whole = collections.defaultdict(bytes)
    for r in sorted(chunks.withColumn("id", warc.record_name(F.col("record")).cast("long")).collect(), key=lambda r: (r.id, r.chunk_no)):
        whole[r.id] += r.chunk
        assert r.payload_bytes == len(whole[r.id]) and r.payload_digest == warc.digest_text(hashlib.sha1(whole[r.id]).digest())
    want = {page: (html or "").encode() for page, _, html in rows if page is not None and page < 20}
    assert set(whole) == {1, 2, 4, 6, 7, 9, 10} and all(whole[k] == want[k] for k in whole)


def test_damaged_archives_are_refused(spark, tmp_path):
    manifest = warc.write_warc(spark.createDataFrame([(1, "u", "payload " * 50)], "page_id long, url string, html string"), f"file://{tmp_path}", compress=False)
    uri = manifest.first().uri
    path = uri.removeprefix("file://")
    raw = open(path, "rb").read()
    for bad, error in ((raw.replace(b"payload payload", b"payload PAYLOAD", 1), ValueError), (raw[:-300], EOFError), (b"x" + raw, ValueError)):
        open(path, "wb").write(bad)
        with pytest.raises(error):
            list(warc.archive_chunks(uri))
