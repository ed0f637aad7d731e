import pytest

from parleyworks.llm.mixing import mixed, sainte_lague, with_tokens
from parleyworks.llm.mixing_queries import vocabulary


def slow(shares, seats, most=None):
    got = dict.fromkeys(shares, 0)
    for _ in range(seats):
        open_ = [s for s in shares if shares[s] > 0 and (most is None or got[s] < most[s])]
        if not open_:
            break
        best = max(open_, key=lambda s: (shares[s] / (2 * got[s] + 1), shares[s], [-ord(c) for c in s]))
        got[best] += 1
    return got


@pytest.mark.parametrize("shares,seats,most", [({"a": 0.5, "b": 0.3, "c": 0.2}, 7, None), ({"a": 0.53, "b": 0.24, "c": 0.23}, 997, None), ({"a": 1.0, "b": 1.0, "c": 0.0}, 5, None), ({"a": 0.6, "b": 0.4}, 50, {"a": 10, "b": 15}), ({}, 3, None), ({"a": 0.9, "b": 0.1}, 0, None)])
def test_highest_quotients(shares, seats, most):
    assert sainte_lague(shares, seats, most) == slow(shares, seats, most)


def test_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>")], "id int, text string")
    got = {r["id"]: r["tokens"] for r in with_tokens(df, vocabulary()).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 1


def test_shares_caps_and_repeats(spark, ws):
    docs = [(k, " A ", "word " * 50) for k in range(200)] + [(1000 + k, "b", "word " * 50) for k in range(20)] + [(2000, None, "x"), (2001, "no target", "y"), (2002, "a", ""), (2003, "a", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("B", 0.4, 3), ("gone", 0.5, 2), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    selection, report = mixed(df, targets, ws, vocabulary(), block_tokens=100)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["a"]["actual_share"] - 0.6) < 0.03 and abs(r["b"]["actual_share"] - 0.4) < 0.03
    assert r["b"]["repeats"] <= 3 and r["a"]["repeats"] == 1 and r["gone"]["tokens"] == 0
    passes = selection.groupBy("doc_id").count().collect()
    assert max(x["count"] for x in passes) <= 3 and not {2000, 2001, 2002, 2003} & {x["doc_id"] for x in passes}
    again, _ = mixed(df, targets, ws, vocabulary(), block_tokens=100)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))
    s, rep = mixed(df.limit(0), targets, ws, vocabulary())
    assert s.count() == 0 and rep.where("tokens > 0").count() == 0


def test_documents_longer_than_blocks(spark, ws):
    """Every document of a source of two can be chosen, though each spans several blocks."""
    docs = [(k, "two", "word " * 500) for k in range(2)] + [(10 + k, "many", "word " * 50) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("two", 0.5, 1), ("many", 0.5, 1)], "source string, target_share double, max_repeats int")
    selection, report = mixed(df, targets, ws, vocabulary(), block_tokens=200)
    r = {x["source"]: x for x in report.collect()}
    assert {x["doc_id"] for x in selection.where("source = 'two'").collect()} == {0, 1}
    assert r["two"]["blocks"] == 2 and r["two"]["tokens"] == r["two"]["tokens_available"] and abs(r["two"]["actual_share"] - 0.5) < 0.02


@pytest.mark.parametrize("seed", range(3))
def test_shares_with_long_and_short_documents(spark, ws, seed):
    """Quotas are tokens: a block that holds a long document counts for all it holds, and one that is too long is passed over."""
    docs = [(k, "mixed", "word " * (8_000 if k % 100 == 0 else 40)) for k in range(400)] + [(1000 + k, "even", "word " * 40) for k in range(100)]
    docs += [(2000 + k, "long", "word " * 1_500) for k in range(7)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("mixed", 0.4, 1), ("even", 0.3, 2), ("long", 0.3, 3)], "source string, target_share double, max_repeats int")
    _, report = mixed(df, targets, ws, vocabulary(), block_tokens=100, seed=seed)
    r = {x["source"]: x for x in report.collect()}
    assert all(x["repeats"] <= x["max_repeats"] for x in r.values()) and sum(x["quota"] for x in r.values()) > 20_000
    assert all(abs(r[s]["tokens"] - r[s]["quota"]) <= 0.01 * r[s]["quota"] for s in ("mixed", "even")) and abs(r["long"]["tokens"] - r["long"]["quota"]) <= 800
