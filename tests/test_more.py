import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import A_LINES, B_LINES

from parleyworks.functions.encoders import hashed_encoder, model_encoder
from parleyworks.operators import graph as G
from parleyworks.operators import lifecycle as L
from parleyworks.sources.files import Store, confined
from parleyworks.streaming.ingest import ingest_transcripts


def test_encoders(spark):
    df = spark.createDataFrame([(1, "red fox red"), (2, None), (3, "  "), (4, "red fox red")], "id int, text string")
    v = {r["id"]: r["v"] for r in df.select("id", hashed_encoder(16)("text").alias("v")).collect()}
    assert v[1] == v[4] and v[2] is None and v[3] is None and abs(np.linalg.norm(v[1]) - 1) < 1e-5
    enc = model_encoder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), prefix="p:", cut=3)
    got = {r["id"]: r["v"] for r in df.select("id", enc("text").alias("v")).collect()}
    assert got[1] == pytest.approx(np.array([5.0, 1.0]) / np.sqrt(26), abs=1e-5)


def test_confined(tmp_path):
    (tmp_path / "in").mkdir()
    ok = tmp_path / "in" / "a.jsonl"
    ok.write_text("")
    (tmp_path / "in" / "link.jsonl").symlink_to("/etc/hostname")
    assert confined(str(ok), [str(tmp_path / "in")]) == str(ok.resolve())
    for bad in (str(tmp_path / "in" / "link.jsonl"), str(tmp_path / "in" / ".." / "b.jsonl"), "/etc/passwd", str(tmp_path / "in" / "a.txt")):
        with pytest.raises(ValueError):
            confined(bad, [str(tmp_path / "in")])


def test_summaries(spark, ws, tmp_path):
    turns = [("long", k, f"t{k}") for k in range(130)] + [("short", k, f"s{k}") for k in range(3)]
    calls = tmp_path / "calls"
    calls.mkdir()

    def summarise(texts):
        (calls / uuid.uuid4().hex).write_text("")
        return f"({len(texts)}:{texts[0]})"

    got = {r["session_id"]: r["summary"] for r in L.summarised(spark.createDataFrame(turns, "session_id string, place int, text string"), summarise, ws).collect()}
    assert got == {"short": "(3:s0)", "long": "(3:(8:(8:t0)))"}
    # 17 chunks, 3 chunks of these, the last three, the short one: none twice
    assert len(list(calls.iterdir())) == 22


def test_ontology_view(spark):
    facts = spark.createDataFrame([("a", True, "Cat-1"), ("b", False, "Cat-1"), ("c", True, "other")], "id string, is_active boolean, category_id string")
    cats = spark.createDataFrame([("Cat-1", "d"), ("cat-2", "d"), ("other", "d")], "category_id string, domain_id string")
    edges = spark.createDataFrame([("a", "c")], "source_id string, target_id string")
    assert sorted((r["category_id"], r["facts"], r["relations"]) for r in G.ontology_view(facts, cats, edges, "CAT").collect()) == [("Cat-1", 1, 1), ("cat-2", 0, 0)]


def test_ingestion_is_incremental(spark, ws, tmp_path):
    d = tmp_path / "src" / "proj"
    d.mkdir(parents=True)
    (d / "a.jsonl").write_text("\n".join(map(json.dumps, A_LINES)))
    (d / "b.jsonl").write_text("\n".join(map(json.dumps, B_LINES)))
    (d / "no.jsonl").write_text("\n".join(map(json.dumps, [*A_LINES, {"type": "user", "message": {"role": "user", "content": "DO-NOT-INDEX"}}])))
    store = Store(spark, str(tmp_path / "store"))
    assert ingest_transcripts(spark, str(tmp_path / "src"), store, ws, markers=["DO-NOT-INDEX"]) == {"files": 3, "exchanges": 2}
    assert store.read("exchanges").count() == 2
    assert ingest_transcripts(spark, str(tmp_path / "src"), store, ws)["files"] == 0
    (d / "c.jsonl").write_text("\n".join(map(json.dumps, A_LINES[1:3])))
    assert ingest_transcripts(spark, str(tmp_path / "src"), store, ws) == {"files": 1, "exchanges": 1}
    assert {r["project"] for r in store.read("exchanges").select(F.col("project")).distinct().collect()} == {"proj"}
