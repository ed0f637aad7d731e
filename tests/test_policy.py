"""Policies on small tables: nulls, thresholds, both directions."""

from pyspark.sql import functions as F

from parleyworks.functions import text as T
from parleyworks.operators import policy as P
from parleyworks.operators.retrieval import TextIndex, text_index

PAIR = "relation_type string, verdict string, confidence double, s_id string, s_fact string, s_scope_type string, s_scope_project string, s_consolidated_count int, t_id string, t_fact string, t_scope_type string, t_scope_project string, t_consolidated_count int"


def pair(kind, verdict, confidence, s=("a", "x", "project", "p", 2), t=("b", "y", "project", "p", 1)):
    return (kind, verdict, confidence, *s, *t)


def plan(spark, *pairs):
    return [(r["plan"], r["plan_type"], r["plan_first"], r["plan_second"]) for r in P.planned(spark.createDataFrame(list(pairs), PAIR).coalesce(1)).collect()]


def test_plans(spark):
    keep = ("keep", None, None, None)
    assert plan(spark, pair("CONTRADICTS", "UNRELATED", 0.6)) == [("delete", None, "a", "b")]
    assert plan(spark, pair("CONTRADICTS", "UNRELATED", 0.59)) == plan(spark, pair("CONTRADICTS", "UNRELATED", None)) == plan(spark, pair("CONTRADICTS", "TRUE_CONFLICT", 1.0)) == plan(spark, pair("OTHER", None, 1.0)) == [keep]
    assert plan(spark, pair("CONTRADICTS", "SUPERSEDED_BY_TARGET", 0.7)) == [("retype", "SUPERSEDES", "b", "a")]
    assert plan(spark, pair("SUPERSEDES", "TARGET_REDUNDANT", 0.9)) == [("deactivate", None, "b", "a")]
    # the one that would go is better confirmed, of another scope, too long to be seen whole, or the same fact
    assert plan(spark, pair("SUPERSEDES", "SOURCE_REDUNDANT", 0.95)) == [keep]
    assert plan(spark, pair("SUPERSEDES", "TARGET_REDUNDANT", 0.95, t=("b", "y", "global", None, 1))) == [keep]
    assert plan(spark, pair("SUPERSEDES", "TARGET_REDUNDANT", 0.95, t=("b", "y" * 2_001, "project", "p", 1))) == [keep]
    assert plan(spark, pair("SUPERSEDES", "UNRELATED", 0.95, t=("a", "x", "project", "p", 2))) == [keep]
    assert P.planned(spark.createDataFrame([], PAIR)).count() == 0


def test_claims(spark):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    rows = [(P.CLAIMED, "2026-01-01T11:45:00Z"), (P.CLAIMED, "2026-01-01T11:00:00Z"), (P.CLAIMED, None), (P.CLAIMED, "no time"), (P.RETRIABLE, None), (P.PERMANENT, None), (5, "2026-01-01T11:59:00Z")]
    df = spark.createDataFrame(rows, "state int, since string").coalesce(1)
    got = df.select(P.is_fresh(F.col("state"), F.col("since"), now).alias("f"), P.may_claim(F.col("state"), F.col("since"), now, True).alias("w"), P.may_claim(F.col("state"), F.col("since"), now, False).alias("o")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, True), (False, True, True), (False, True, True), (False, True, True), (False, False, True), (False, False, True)]


def test_error_kinds(spark):
    cases = {
        "Request failed with status code 400": "deterministic", "API Error: 500 oops": "transient", "status: 429": "transient", "http error 418": "unknown", "response 400 ms timeout": "transient", "retry after 400 ms": "unknown",
        "Prompt is too long": "deterministic", "socket hang up": "transient", "Invalid API key": "transient", "": "unknown",
    }
    df = spark.createDataFrame([(m,) for m in cases], "m string")
    assert {r["m"]: r["k"] for r in df.select("m", P.error_kind(F.col("m")).alias("k")).collect()} == cases


def test_coverage_states(spark):
    facts = spark.createDataFrame([("a", True, "2"), ("b", True, "3"), ("c", False, "9")], "id string, is_active boolean, created_at string")
    queue = spark.createDataFrame([("a",), ("c",), ("a",)], "id string")
    state = lambda *a: tuple(P.principle_coverage(facts, queue, *a).first())
    assert state(0, None, True) == ("no-principles", 2, 1) and state(1, None, True) == ("unscanned", 2, 1) and state(1, ("3", "b"), False) == ("principles-changed", 2, 1)
    assert state(1, ("2", "a"), True) == ("partial", 1, 1) and state(1, ("3", "b"), True) == ("complete", 0, 1)


def test_names(spark):
    df = spark.createDataFrame([("My-Slug ",), ("-no",), ("a b",), (None,), ("x" * 65,)], "s string").coalesce(1)
    assert [r[0] for r in df.select(T.is_slug("s")).collect()] == [True, False, False, None, False]
    assert spark.createDataFrame([("ab",)], "s string").select(T.version_number("s")).first()[0] == 1000 + 97 * 31 + 98


def test_an_index_is_built_again_when_the_table_changes(spark, ws):
    built = []
    df = spark.createDataFrame([(1, "one two"), (2, "two"), (3, None)], "doc_id bigint, text string")

    def build():
        built.append(1)
        return TextIndex(df, ws, "doc_id", "text")

    ix = text_index(("app", "/t", 1), build)
    assert text_index(("app", "/t", 1), build) is ix and len(built) == 1 and (ix.docs, ix.mean_len) == (2, 1.5)
    assert {r["token"]: r["df"] for r in ix.frequency.collect()} == {"one": 1, "two": 2}
    other = text_index(("app", "/t", 2), build)
    assert other is not ix and len(built) == 2
    ws.drop(other.post)
    assert text_index(("app", "/t", 2), build) is not other and len(built) == 3
