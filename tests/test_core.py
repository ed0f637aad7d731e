import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from parleyworks.functions import text as T
from parleyworks.operators import analytics as A
from parleyworks.operators import graph as G
from parleyworks.operators import lifecycle as L
from parleyworks.operators import retrieval as S
from parleyworks.operators import tables as R
from parleyworks.schema import conform, schema


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column("v").alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, "a  b\n c", T.collapsed) == "a b c"
    assert one(spark, "x" * 250, T.snippet) == "x" * 200 + "..."
    assert one(spark, None, T.snippet) is None
    assert one(spark, "y" * 200, T.clipped) == "y" * 159 + "…"
    assert one(spark, "  The END.. ", T.comparable) in ("the end", "the end..")
    assert one(spark, "/a/b.c_d", T.path_slug) == "-a-b-c-d"
    assert one(spark, "/a/b c/", T.encoded_path) == "-a-b-c"
    assert one(spark, "mcp__srv_x__run", T.short_tool) == "run"
    assert one(spark, "ab", T.session_key) is None
    assert one(spark, "q <summary> s </summary>", T.summary_of) == "s"
    assert json.loads(one(spark, "so: ```json\n[1, 2]\n``` ok", T.json_of)) == [1, 2]
    assert one(spark, "no json", T.json_of) is None
    for raw, want in (("Decision", "decision"), ("requirements", "constraint"), ("x|pattern|y", "pattern"), ("other", "knowledge"), (None, "knowledge")):
        assert one(spark, raw, T.category_of) == want
    assert one(spark, float("nan"), T.unit_interval, "double") is None
    assert one(spark, 7.0, T.unit_interval, "double") == 1.0


def test_conform(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "7", 2)], "id string, line_start string, extra int")
    out = conform(df, schema("exchanges"))
    assert out.columns == schema("exchanges").fieldNames()
    assert [r["line_start"] for r in out.orderBy("id").collect()] == [None, 7]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    once = R.upsert(old, new, ["id"])
    assert rows(once) == rows(R.upsert(once, new, ["id"])) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(R.insert_absent(old, new, ["id"])) == [("a", 1), ("b", 2), ("c", 4)]
    gone = spark.createDataFrame([("a",)], "id string")
    parents, children = R.delete_with_children(old, [(spark.createDataFrame([("a", 9), ("b", 8)], "fk string, n int"), "fk")], gone)
    assert rows(parents) == [("b", 2)] and rows(children) == [("b", 8)]


def test_pages_batches_budget(spark, ws):
    df = spark.createDataFrame([(k // 2, f"i{k}") for k in range(10)], "a int, b string")
    assert rows(R.keyset_page(df, ["a", "b"], (1, "i2"), 3)) == [(1, "i3"), (2, "i4"), (2, "i5")]
    assert R.keyset_page(df, ["a", "b"], None, 4).count() == 4
    assert {r["total"] for r in R.offset_page(df, [F.col("b")], 2, 3).collect()} == {10}
    b = R.batched(ws, df.withColumn("g", F.lit(1)), ["g"], ["b"], 3)
    assert b.groupBy("batch").count().where("batch = 3").first()["count"] == 1
    idx = spark.createDataFrame([(1, k) for k in range(11)], "g int, k int")
    assert [r["k"] for r in R.spread(idx, ["g"], "k", 3).orderBy("k").collect()] == [0, 5, 10]
    lines = spark.createDataFrame([("q", 1, 500), ("q", 2, 600), ("q", 3, 10), ("p", 1, 5000)], "q string, n int, size int")
    assert rows(R.budgeted(lines, ["q"], [F.col("n")], F.col("size"), 1000).select("q", "n")) == [("p", 1), ("q", 1)]


def test_tool_sequences_counts_pairs_without_expanding_them(spark, ws):
    calls = [("e1", t, f"{k:02d}") for k, t in enumerate(["A", "B", "A", "B"])] + [("e2", "A", "00"), ("e2", "B", "00"), (None, "A", "01"), ("e3", None, "01")]
    df = spark.createDataFrame(calls, "exchange_id string, tool_name string, timestamp string")
    got = {(r["tool_name"], r["next_tool"]): r["n"] for r in A.tool_sequences(df, ws, 1, 10, []).collect()}
    assert got == {("A", "B"): 3, ("A", "A"): 1, ("B", "B"): 1, ("B", "A"): 1}
    assert A.tool_sequences(df.limit(0), ws, 1, 10, []).count() == 0


def test_project_connections_need_no_expansion(spark):
    df = spark.createDataFrame([("s", "a")] * 3 + [("s", "b")] * 2 + [(None, "a"), ("t", None)], "session_id string, project string")
    assert rows(A.project_connections(df, 2)) == [("a", "b", 6)]


def test_quantiles_and_duplicates(spark, ws):
    df = spark.createDataFrame([(float(k % 7),) for k in range(50)] + [(None,)], "v double")
    values = sorted(float(k % 7) for k in range(50))
    want = {p: values[min(49, int(p * 50))] for p in (0.0, 0.25, 0.5, 0.75, 1.0)}
    assert {r["point"]: r["value"] for r in A.quantiles(df, "v", list(want), ws).collect()} == want
    assert A.quantiles(df.limit(0), "v", [0.5]).count() == 0
    facts = spark.createDataFrame([("a", "x", "global", None, 1, "1", True), ("b", "x", "global", "", 3, "2", True), ("c", "x", "project", "p", 9, "0", True), ("d", "x", "global", None, 5, "0", False)], "id string, fact string, scope_type string, scope_project string, consolidated_count int, created_at string, is_active boolean")
    assert rows(A.content_duplicates(facts).select("id", "keeper")) == [("a", "b"), ("b", "b")]


@pytest.mark.parametrize("seed", range(3))
def test_votes_do_not_depend_on_order(spark, seed):
    import random

    votes = [("i", "yes", 0.5, 1), ("i", "yes", 0.9, 2), ("i", "yes", 0.7, 3), ("i", "no", 0.9, 1), ("j", "yes", None, 1), ("j", "yes", 0.4, 2), ("i", "yes", 0.1, 3)]
    random.Random(seed).shuffle(votes)
    df = spark.createDataFrame(votes, "item string, verdict string, confidence double, vote int")
    assert rows(A.majority(df, ["item"], "verdict", "confidence", "vote", 2)) == [("i", "yes", 3, 0.7), ("j", "yes", 2, 0.4)]
    assert rows(A.majority(df, ["item"], "verdict", "confidence", "vote", 2, upper=False))[1] == ("j", "yes", 2, 0.0)


def test_bootstrap_and_jaccard(spark):
    df = spark.createDataFrame([("g", float(k)) for k in range(100)], "g string, v double")
    r = A.bootstrap_means(df, "g", "v", 200, 1).first()
    assert 40 < r["low"] < 49.5 < r["high"] < 59
    j = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>").select(A.jaccard(F.col("a"), F.col("b")).alias("j"))
    assert sorted(round(x["j"], 3) for x in j.collect()) == [0.333, 1.0]


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    x[50:90] = x[10]  # many copies: ties go to the smaller id
    vectors = [(k, [float(v) for v in x[k]]) for k in range(300)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    df = spark.createDataFrame(vectors, "item_id long, embedding array<double>").repartition(5)
    got = S.knn(df.where("item_id in (10, 60, 200, 901)").withColumnRenamed("item_id", "query_id"), df, 5, chunk=64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in (10, 60, 200):
        s = u @ u[q]
        want = [i for i in sorted(range(300), key=lambda i: (-round(s[i], 9), i)) if i != q][:5]
        assert [r["item_id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want
    assert got.where("query_id = 901").count() == 0
    assert S.knn(df.limit(0).withColumnRenamed("item_id", "query_id"), df, 5).count() == 0


def test_bm25_and_ladder(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red hen"), (3, "blue fox jumps"), (4, None), (5, "")], "doc_id int, text string")
    post = S.postings(docs, "doc_id", "text")
    q = spark.createDataFrame([("q", "red"), ("q", "fox"), ("q", "nowhere"), ("q", "red")], "query_id string, token string")
    ranked = [r["doc_id"] for r in S.bm25(q, post, 3, 8 / 3, "doc_id").orderBy("rank").collect()]
    assert ranked[0] == 1 and set(ranked) == {1, 2, 3}
    assert S.bm25(q.where("token != 'nowhere'"), post, 3, 3.0, "doc_id", all_tokens=True).select("doc_id").collect()[0][0] == 1
    rungs = {r["doc_id"]: r["rung"] for r in S.rarest_ladder(q, post, "doc_id").collect()}
    assert rungs == {1: 2, 3: 1}


FACTS = "id string, fact string, is_active boolean, category_id string, consolidated_count int, updated_at string"
EDGES = "rel_id int, source_id string, relation_type string, target_id string, created_at string"


def test_graph(spark, ws):
    facts = spark.createDataFrame([(c, c.upper(), c != "x", "k", 1, "") for c in "abcdx"], FACTS)
    edges = spark.createDataFrame([(1, "a", "SUPPORTS", "b", "1"), (2, "b", "CONTRADICTS", "a", "2"), (3, "b", "INFLUENCES", "c", "3"), (4, "x", "SUPPORTS", "c", "4"), (5, "c", "INFLUENCES", "x", "5")], EDGES)
    seeds = spark.createDataFrame([("a",)], "id string")
    got = {(r["id"], r["hop"], r["relevance"], r["relation_type"]) for r in G.related(seeds, edges, facts, ws, 3).collect()}
    assert got == {("b", 1, 1.0, "SUPPORTS"), ("c", 2, 0.6, "INFLUENCES")}
    assert rows(G.orphans(facts, edges).select("id")) == [("d",)]
    c = G.consistency_counts(facts, edges).first()
    assert (c["active"], c["contradicts"], c["orphans"], c["orphan_rate"]) == (4, 1, 1, 0.25)
    turned = spark.createDataFrame([(9, "b", "SUPPORTS", "a", ""), (8, "c", "INFLUENCES", "b", ""), (7, "a", "SUPPORTS", "a", ""), (6, "c", "INFLUENCES", "b", "")], EDGES)
    assert rows(G.new_edges(edges, turned).select("source_id", "target_id")) == [("c", "b")]
    assert G.related(seeds, edges.limit(0), facts, ws).count() == 0


def test_merges_follow_chains(spark, ws):
    sizes = spark.createDataFrame([("a", "d", 5), ("b", "d", 3), ("c", "d", 1)], "category_id string, domain_id string, facts int")
    similar = spark.createDataFrame([("a", "b", 0.95), ("b", "a", 0.95), ("c", "b", 0.92), ("a", "c", 0.5)], "query_id string, item_id string, cosine double")
    merges = G.merge_candidates(similar, sizes, 0.9)
    assert rows(merges.select("keep", "drop")) == [("a", "b"), ("b", "c")]
    facts = spark.createDataFrame([(1, "c"), (2, "b"), (3, "a"), (4, None)], "id int, category_id string")
    assert rows(G.apply_merges(facts, merges, ws).select("id", "category_id")) == [(1, "a"), (2, "a"), (3, "a"), (4, None)]


def test_consolidation(spark):
    facts = spark.createDataFrame([(c, c, True, "k", 1, "") for c in "abcdef"], FACTS)
    verdicts = spark.createDataFrame([("a", "b", "DUPLICATE", None), ("c", "d", "CONTRADICTION", None), ("e", "f", "EVOLUTION", "e2")], "old_id string, new_id string, verdict string, merged string")
    out, revisions = L.consolidated(facts, verdicts, "now")
    state = {r["id"]: (r["fact"], r["is_active"], r["consolidated_count"]) for r in out.collect()}
    assert state == {"a": ("a", True, 2), "b": ("b", False, 1), "c": ("c", False, 1), "d": ("d", True, 1), "e": ("e2", True, 2), "f": ("f", False, 1)}
    assert [(r["fact_id"], r["previous_fact"]) for r in revisions.collect()] == [("e", "e")]


def test_extraction_and_judges_are_injected(spark):
    ex = spark.createDataFrame([("s", "t1"), ("s", "t2")], "session_id string, text string")

    def extractor(p):
        import pandas as pd

        return pd.DataFrame([(s, f, c) for s, t in zip(p["session_id"], p["text"]) for f, c in ((t + " Same.", 0.9), ("low", 0.1), ("Shared fact.", 0.8), ("shared  fact", 0.75))], columns=["session_id", "fact", "confidence"])

    got = L.extracted(ex, extractor, "session_id string, fact string, confidence double")
    assert rows(got.select("fact")) == [("Shared fact.",), ("t1 Same.",), ("t2 Same.",)]


def test_plans(spark, data):
    """Top-k by a window limit, semi and anti joins without nested loops, columns pruned at the scan."""
    from parleyworks.plans import registry

    for name in ("j6_orphans", "j7_sessions_without_facts", "a14_tool_sequences", "v2_knn", "v4_bm25", "w2_last_session"):
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
    plan = registry.QUERIES["w2_last_session"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "assistant_message" not in plan


def test_findings_and_token_caps(spark):
    rows_ = [(1, 0, "a", 0.9), (1, 1, "a", 0.9), (1, 1, "a", 0.8), (1, 5, "a", 0.9), (1, 2, "zz", 0.9), (1, 3, "b", 0.1), (1, 3, "b", 1.5), (2, 0, "a", 0.7)]
    df = spark.createDataFrame(rows_, "batch int, item_index int, slug string, confidence double")
    assert rows(L.valid_findings(df, 4, ["a", "b"], 0.6).select("batch", "item_index")) == [(1, 0), (2, 0)]
    words = "alpha beta gamma delta epsilon zeta eta theta id7 QA".split()
    got = spark.createDataFrame([(words,)], "w array<string>").select(T.capped_tokens(F.col("w"), 3, 5).alias("t")).first()["t"]
    assert got == ["epsilon", "alpha", "delta", "id7", "QA"]
    assert spark.createDataFrame([(["a", "b", "a"],)], "w array<string>").select(T.capped_tokens(F.col("w")).alias("t")).first()["t"] == ["a", "b"]


def test_hot_keys_are_bounded(spark):
    from parleyworks.session import hot_keys

    df = spark.createDataFrame([("h",)] * 60 + [(f"k{i}",) for i in range(40)] + [(None,)] * 50, "k string")
    assert hot_keys(df, "k", share=0.1, least=10) == ["h"]
    assert hot_keys(df, "k", share=0.1, least=1000) == [] and hot_keys(df.limit(0), "k") == []


def test_merges_in_a_loop_go_to_its_least(spark, ws):
    pairs = [("b", "c"), ("c", "a"), ("a", "b"), ("t", "b"), ("0", "t"), *[(f"k{k:02d}", f"k{k + 1:02d}") for k in range(40)]]
    merges = spark.createDataFrame([(d, k, True) for d, k in pairs], "drop string, keep string, same_domain boolean")
    facts = spark.createDataFrame([(d,) for d, _ in pairs] + [("free",)], "category_id string")
    got = G.apply_merges(facts.withColumn("was", F.col("category_id")), merges, ws).collect()
    assert {r["was"]: r["category_id"] for r in got} == {x: "a" for x in "abct0"} | {f"k{k:02d}": "k40" for k in range(40)} | {"free": "free"}


def test_the_last_text_of_an_id_counts_with_its_reason(spark):
    facts = spark.createDataFrame([("f", "old", True, "k", 1, ""), ("g", "same", True, "k", 1, "")], FACTS)
    changes = spark.createDataFrame([("f", "zebra", "a first", 1), ("f", "apple", "b last", 2), ("g", "same", "none", 1), ("f", None, "null", 3)], "id string, new_fact string, reason string, place int")
    out, revisions = L.rewritten(facts, changes, "now")
    assert {r["id"]: r["fact"] for r in out.collect()} == {"f": "apple", "g": "same"}
    assert rows(revisions.select("fact_id", "previous_fact", "new_fact", "reason")) == [("f", "old", "apple", "b last")]


def test_equal_rows_are_drawn_apart(spark):
    """With all rows equal but two values, the interval is that of the same numbers with a column that tells them apart."""
    df = spark.createDataFrame([("g", float(k % 2)) for k in range(400)], "g string, v double")
    r = A.bootstrap_means(df, "g", "v", 300, 1).first()
    assert 0.42 < r["low"] < 0.48 and 0.52 < r["high"] < 0.58
