import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parleyworks.sources import files, sync, transcripts
from parleyworks.streaming import ingest

A_LINES = [
    {"type": "summary", "summary": "x"},
    {"type": "user", "uuid": "1", "timestamp": "t1", "sessionId": "s", "cwd": "/w", "message": {"role": "user", "content": "hello"}},
    {"type": "assistant", "uuid": "2", "timestamp": "t2", "sessionId": "s", "cwd": "/w", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "u1", "name": "Read", "input": {"p": 1}}]}},
    {"type": "user", "uuid": "3", "timestamp": "t3", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u1", "content": "ok"}]}},
    {"type": "assistant", "uuid": "4", "timestamp": "t4", "sessionId": "s", "cwd": "/w2", "message": {"role": "assistant", "content": "done"}},
    {"type": "user", "uuid": "5", "timestamp": "t5", "message": {"role": "user", "content": "unanswered"}},
]
B_LINES = [
    {"type": "session_meta", "timestamp": "t0", "payload": {"id": "s9", "cwd": "/p/q", "git": {"branch": "main"}}},
    {"type": "response_item", "timestamp": "t1", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}},
    {"type": "response_item", "timestamp": "t2", "payload": {"type": "function_call", "name": "shell", "call_id": "c1", "arguments": "{}"}},
    {"type": "response_item", "timestamp": "t3", "payload": {"type": "function_call_output", "call_id": "c1", "output": "out"}},
    {"type": "response_item", "timestamp": "t4", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "went"}]}},
]


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "proj"
    d.mkdir()
    (d / "a.jsonl").write_text("\n".join(["not json", *map(json.dumps, A_LINES), ""]))
    (d / "b.jsonl").write_text("\n".join(map(json.dumps, B_LINES)))
    return str(d)


def test_both_dialects(spark, ws, folder):
    raw = transcripts.lines(spark, folder, ws)
    kinds = {r["file"].rsplit("/", 1)[1]: r["dialect"] for r in transcripts.dialects(raw).collect()}
    assert kinds == {"a.jsonl": "A", "b.jsonl": "B"}
    a = transcripts.exchanges(transcripts.messages_a(raw.where("file like '%a.jsonl'")), ws).collect()
    assert [(r["user_message"], r["assistant_message"], [t["tool_name"] for t in r["tools"]], r["cwd"]) for r in a] == [("hello", "hi\n\ndone", ["Read"], "/w2")]
    b = transcripts.exchanges(transcripts.messages_b(raw.where("file like '%b.jsonl'"), ws), ws).collect()
    assert [(r["user_message"], r["assistant_message"], r["tools"][0]["tool_result"], r["session_id"], r["git_branch"]) for r in b] == [("go", "went", "out", "s9", "main")]
    rows_a = transcripts.indexed(transcripts.exchanges(transcripts.messages_a(raw.where("file like '%a.jsonl'")), ws)).first()
    assert (rows_a["project"], rows_a["line_start"], rows_a["line_end"]) == ("proj", 3, 6)
    assert transcripts.excluded_files(raw, ["session_meta"]).count() == 1
    assert {r["project"]: r["excluded"] for r in transcripts.file_projects(raw, ["/p/"]).collect()} == {"-w": False, "-p-q": True}
    md = transcripts.rendered(raw.where("file like '%a.jsonl'"), ws).first()["markdown"]
    assert "## User\n\nhello" in md and "**Read**" in md and "```\nok\n```" in md
    assert transcripts.lines(spark, folder, ws, "*.none").count() == 0


def test_archives(spark, tmp_path):
    import zstandard

    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(b"packed"))
    (tmp_path / "y.jsonl").write_text("plain")
    (tmp_path / "bad.jsonl.zst").write_bytes(b"nothing")
    got = {r["file"].rsplit("/", 1)[1]: r["text"] for r in files.archives(spark, str(tmp_path)).collect()}
    assert got == {"x.jsonl": "packed", "y.jsonl": "plain", "bad.jsonl": None}
    assert {r["text"] for r in files.archives(spark, str(tmp_path), cap=2).collect()} == {None}
    seen = spark.createDataFrame([], "file string, modified timestamp")
    fresh = files.newer_files(spark, str(tmp_path), seen)
    assert fresh.count() == 3 and files.newer_files(spark, str(tmp_path), fresh).count() == 0


def test_store_versions(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "state"))
    assert store.version("t") == 0
    with pytest.raises(FileNotFoundError):
        store.read("t")
    store.publish("t", spark.range(3))
    assert store.publish("t", store.read("t").unionByName(spark.range(5, 6))) == 2
    assert store.read("t").count() == 4


FACTS = "id string, fact string, scope_type string, scope_project string, created_at string, is_active boolean"
EDGES = "rel_id bigint, source_id string, target_id string, relation_type string"


def test_sync_import(spark, tmp_path):
    ours = spark.createDataFrame([("a", "x", "global", None, "1", True), ("b", "y", "global", None, "1", True)], FACTS)
    our_edges = spark.createDataFrame([(1, "a", "b", "SUPPORTS")], EDGES)
    theirs = spark.createDataFrame([("a2", "x", "global", "", "2", True), ("n", "new", "global", None, "2", True), ("n2", "new", "global", None, "3", True), ("b", "changed", "global", None, "9", True), (None, "q", "global", None, "1", True)], FACTS)
    their_edges = spark.createDataFrame([(1, "b", "a2", "SUPPORTS"), (2, "n2", "a2", "INFLUENCES"), (3, "n", "n2", "INFLUENCES"), (4, "n", "b", "UNKNOWN"), (5, "n", "zz", "SUPPORTS")], EDGES)
    facts, edges = sync.merged(ours, our_edges, theirs, their_edges)
    assert rows(facts.select("id")) == [("n",)]
    assert rows(edges.select("source_id", "target_id", "relation_type")) == [("n", "a", "INFLUENCES")]
    again = sync.merged(ours.unionByName(facts), our_edges.unionByName(edges), theirs, their_edges)
    assert again[0].count() == 0 and again[1].count() == 0
    written = sync.export(ours, our_edges, spark.createDataFrame([("k", "d")], "category_id string, domain_id string"), str(tmp_path))
    assert written == {"facts": 2, "relations": 1, "categories": 1}
    assert sync.read(spark, str(tmp_path))[0].count() == 2


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "events")
    e = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit(1.0).alias("value"))
    e.repartition(3).write.parquet(path)
    batch = ingest.windowed_counts(e, "ts", "1 hour", None, ["user_id"])
    assert batch.agg(F.sum("n")).first()[0] == 200
    store = files.Store(spark, str(tmp_path / "state"))
    from parleyworks.operators.tables import upsert

    stream = ingest.table_stream(spark, path, e.schema, 1)
    ingest.upsert_each_batch(stream, store, "events", str(tmp_path / "p"), lambda old, new: new if old is None else upsert(old, new, ["event_id"]))
    assert rows(store.read("events").select("event_id")) == rows(e.select("event_id"))
    twice = ingest.table_stream(spark, path, e.schema).unionByName(ingest.table_stream(spark, path, e.schema))
    ingest.run_to_end(ingest.without_repeats(twice, ["event_id"], "ts", "30 days"), str(tmp_path / "o"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 200
    shown = spark.createDataFrame([("s", f"f{k}", f"2026-01-0{1 + k % 9} 00:00:00") for k in range(9)], "session_id string, id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert ingest.ledger(shown, "2026-01-09 00:00:00", most=3).first()["ids"] == ["f6", "f7", "f8"]


def test_archives_of_any_size_by_lines(spark, tmp_path):
    import zstandard

    big = "\n".join(["first", "", *(f'{{"n": {k}}}' for k in range(30_000))]) + "\r\n"
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(big.encode()))
    (tmp_path / "bad.jsonl.zst").write_bytes(b"nothing")
    (tmp_path / "y.jsonl").write_text("plain")
    got = files.archive_lines(spark, str(tmp_path), per_frame=1_000)
    assert got.where("file like '%x.jsonl'").agg(F.count("*"), F.min("line"), F.max("line"), F.max_by("text", "line")).first() == (30_001, 1, 30_002, '{"n": 29999}')
    assert got.where("file like '%y.jsonl'").first()["text"] == "plain" and got.where("file like '%bad%'").count() == 0


def test_lines_of_a_file_in_splits(spark, ws, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"line {k}\r\n" if k % 3 else "\n" for k in range(1, 2_001)))
    (tmp_path / "b.jsonl").write_text("only")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = [(r["file"].rsplit("/", 1)[1], r["line"], r["text"]) for r in transcripts.lines(spark, str(tmp_path), ws).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted([("a.jsonl", k, f"line {k}") for k in range(1, 2_001) if k % 3] + [("b.jsonl", 1, "only")])


def test_filled_forward(spark, ws):
    from parleyworks.operators.tables import filled_forward

    data = [(g, k, f"v{k}" if k % 7 == 3 else None, k if k == 0 and g == "a" else None) for g in "abc" for k in range(40)]
    got = filled_forward(ws, spark.createDataFrame(data, "g string, k int, v string, w int"), "g", "k", ["v", "w"]).collect()
    last = lambda k: next((f"v{j}" for j in range(k, -1, -1) if j % 7 == 3), None)
    assert sorted(map(tuple, got), key=repr) == sorted([(g, k, last(k), 0 if g == "a" else None) for g in "abc" for k in range(40)], key=repr)


def test_upserts_write_the_buckets_they_change(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "store"))
    rows_of = lambda pairs: spark.createDataFrame(pairs, "id int, v string")
    assert store.upsert("t", rows_of([]), ["id"]) == 1 and store.read("t").count() == 0
    store.upsert("t", rows_of([(k, "a") for k in range(500)]), ["id"], buckets=16)
    before = {r["_bucket"]: r["_path"] for r in spark.read.parquet(str(tmp_path / "store/t/v=2")).collect()}
    assert store.upsert("t", rows_of([(7, "b"), (1_000, "c")]), ["id"], buckets=16) == 3
    after = {r["_bucket"]: r["_path"] for r in spark.read.parquet(str(tmp_path / "store/t/v=3")).collect()}
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    got = {r["id"]: r["v"] for r in store.read("t").collect()}
    assert got == {k: "a" for k in range(500)} | {7: "b", 1_000: "c"}
    assert store.upsert("t", rows_of([(7, "b"), (1_000, "c")]), ["id"], buckets=16) == 4 and store.read("t").count() == 501
    assert store.upsert("t", rows_of([]), ["id"], buckets=16) == 4


def test_upsert_stream(spark, tmp_path):
    store, source = files.Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    for part in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b")]):
        spark.createDataFrame(part, "id int, v string").coalesce(1).write.mode("append").parquet(source)
        ingest.upsert_stream(spark.readStream.schema("id int, v string").parquet(source), store, "t", ["id"], str(tmp_path / "progress"))
    assert {r["id"]: r["v"] for r in store.read("t").collect()} == {1: "a", 2: "b", 3: "b"}
