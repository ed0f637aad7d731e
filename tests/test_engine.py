import pytest
from pyspark.sql import functions as F

from parleyworks.engine import Engine, SearchRequest
from parleyworks.operators import filters as P
from parleyworks.operators import retrieval as S
from parleyworks.operators import tables as R


@pytest.fixture(scope="module")
def engine(spark):
    vec = lambda *x: [float(v) for v in x]
    ex = spark.createDataFrame(
        [("e1", "p", "2026-01-01T00:00:00Z", "red fox", "the quick answer line", "a/1.jsonl", vec(1, 0), "claude-code", "s1"), ("e2", "p", "2026-02-01T00:00:00Z", "blue hen", "another answer line", "a/1.jsonl", vec(0, 1), None, "s1"), ("e3", "q", "2026-03-01T00:00:00Z", "red hen", None, "a/2.jsonl", vec(1, 1), "codex", "s2"), ("e4", "q", "2026-03-02T00:00:00Z", None, "", "a/3.jsonl", None, "codex", None)],
        "id string, project string, timestamp string, user_message string, assistant_message string, archive_path string, embedding array<double>, coding_agent string, session_id string",
    )
    facts = spark.createDataFrame(
        [("f1", "one fact", "global", None, True, "decision", "k1", ["e1", "gone"], 1, "2026-01-01"), ("f2", "two", "project", "/w/p.x", True, "pattern", "k1", ["e2"], 2, "2026-01-02"), ("f3", "three", "project", "-w-q", True, "pattern", "k2", None, 3, "2026-01-03"), ("f4", "off", "global", None, False, "pattern", "k2", [], 1, "2026-01-04")],
        "id string, fact string, scope_type string, scope_project string, is_active boolean, category string, category_id string, source_exchange_ids array<string>, consolidated_count int, created_at string",
    )
    edges = spark.createDataFrame([(1, "f1", "SUPPORTS", "f2", "1"), (2, "f2", "CONTRADICTS", "f3", "2")], "rel_id int, source_id string, relation_type string, target_id string, created_at string")
    cats = spark.createDataFrame([("k1", "d"), ("k2", "d")], "category_id string, domain_id string")
    return Engine(spark, ex, facts, edges, cats)


def test_requests_are_checked():
    for bad in ({"limit": 0}, {"limit": 51}, {"mode": "x"}, {"after": "2026-13-01"}, {"before": "yesterday"}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)


def test_search(spark, engine):
    q = spark.createDataFrame([("q", "red", [1.0, 0.1])], "query_id string, text string, embedding array<double>")
    hits = {r["id"]: r["match"] for r in engine.search(q, SearchRequest(limit=2)).collect()}
    assert hits == {"e1": "vector", "e3": "vector"}
    text = {r["id"] for r in engine.search(q, SearchRequest(mode="text")).collect()}
    assert text == {"e1", "e3"}
    assert {r["id"] for r in engine.search(q, SearchRequest(after="2026-01-15", agent="claude-code", mode="vector")).collect()} == {"e2"}
    # the filter after the search leaves fewer
    assert engine.search(q, SearchRequest(limit=1, agent="codex", mode="vector"), prefilter=False).count() == 0
    assert engine.search(q, SearchRequest(before="2026-02-01", mode="vector")).select("id").collect()[0][0] == "e1"


def test_concepts(spark, engine):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, embedding array<double>")
    assert engine.search_all(q).first()["archive_path"] in ("a/1.jsonl", "a/2.jsonl")
    with pytest.raises(ValueError):
        engine.search_all(q.limit(1))


def test_facts_and_graph(spark, engine):
    vectors = spark.createDataFrame([("f1", [1.0, 0.0]), ("f2", [0.9, 0.1]), ("f3", [1.0, 0.05]), ("f4", [1.0, 0.0])], "item_id string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    found = engine.search_facts(q, [vectors, vectors.where("item_id = 'f2'")], project="/w/p.x", least=0.5)
    assert [r["item_id"] for r in found.orderBy("rank").collect()] == ["f1", "f2"]
    assert engine.search_facts(q, [vectors], category="pattern", least=0.5).count() == 2
    assert "one fact" in engine.context(found).first()["block"]
    seeds = spark.createDataFrame([("f1",)], "id string")
    assert {(r["id"], r["hop"], r["relevance"]) for r in engine.explore(seeds, 2).collect()} == {("f2", 1, 1.0), ("f3", 2, 0.42)}
    with pytest.raises(ValueError):
        engine.explore(seeds, 4)
    assert [r["exchange_id"] for r in engine.provenance(seeds).collect()] == ["e1"]
    assert engine.ontology().count() == 1
    report = engine.report()
    assert "## Coverage" in report and "| p |" in report


def test_filters(spark):
    df = spark.createDataFrame([("ok", "x"), ("/clear", "y" * 300), ("", "z"), (None, None), ("<command-name>x", "y"), ("a real question?", "short"), ("네", "n" * 250)], "u string, a string")
    assert [r["u"] for r in df.where(P.substantive(F.col("u"), F.col("a"))).collect()] == ["a real question?", "네"]
    p = spark.createDataFrame([("x-llm", "hi", False), ("x", "Warmup", True), ("x", "Warmup", False), ("x", "Warmup routine", True), (None, None, None)], "p string, u string, s boolean")
    assert p.where(P.pollution(F.col("p"), F.col("u"), F.col("s"), "-llm", P.WORKER_LEADS)).count() == 2
    assert p.where(P.pollution(F.col("p"), F.col("u"), F.col("s"), "-llm", handshake=False)).count() == 1
    d = spark.createDataFrame([("/a/b",), ("/a/bc",), ("/a/b/c",), (None,)], "d string")
    assert d.where(P.under(F.col("d"), ["/a/b/"])).count() == 2


def test_quota_and_recall(spark):
    df = spark.createDataFrame([("g", f"i{k}", k, k < 3) for k in range(10)], "g string, id string, v int, own boolean")
    got = [r["id"] for r in R.with_quota(df, ["g"], F.col("own"), [F.desc("v")], 4).orderBy("rank").collect()]
    assert got == ["i2", "i1", "i9", "i8"]
    truth = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, item_id string")
    assert S.recall_at(truth.where("item_id = 'a'"), truth).first()["recall"] == 0.5


def test_hot_groups_are_numbered_across_tasks(spark, ws):
    df = spark.createDataFrame([("h", k) for k in range(200)] + [("s", 1), ("s", 0)], "g string, k int").repartition(7)
    n = R.numbered(ws, df, ["g"], ["k"])
    assert n.where("g = 'h' and number != k").count() == 0 and n.where("g = 's'").agg(F.max("number")).first()[0] == 1
    b = R.batched(ws, df, ["g"], ["k"], 50)
    assert b.where("g = 'h'").select("batch").distinct().count() == 4
    assert R.numbered(ws, df.limit(0), ["g"], ["k"]).count() == 0
