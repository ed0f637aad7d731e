import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parleyworks.operators.hierarchy import ancestors_of, build_hierarchy, descendants_of, paths_of, prefix_sums, with_paths

SCHEMA = "id string, parent string"


def brute(pairs):
    parent = {}
    for i, p in pairs:
        if i is not None:
            known = parent.get(i)
            parent[i] = p if known is None else known if p is None else min(p, known)
    out = {}
    for i in parent:
        seen, at, depth = [], i, 0
        while True:
            p = parent[at]
            if p is None or p not in parent:
                out[i] = (at, depth)
                break
            seen.append(at)
            at, depth = p, depth + 1
            if at in seen:
                out[i] = ("cycle", -1)
                break
    size = {i: 0 for i in parent}
    for i in parent:
        if out[i][1] >= 0:
            at = i
            while True:
                size[at] += 1
                if at == out[i][0]:
                    break
                at = parent[at]
    return {i: (*out[i], size[i] or None) for i in parent}


def check(spark, ws, pairs):
    tree = build_hierarchy(spark.createDataFrame(pairs, SCHEMA), ws)
    got = {r["id"]: r for r in tree.collect()}
    want = brute(pairs)
    assert {i: (r["root"], r["depth"], r["subtree_size"]) for i, r in got.items()} == want
    # ranges: of one root they are 0..n-1, and a node's range holds its children's
    by_root = {}
    for r in got.values():
        if r["depth"] >= 0:
            by_root.setdefault(r["root"], []).append(r["tree_pre"])
    assert all(sorted(v) == list(range(len(v))) for v in by_root.values())
    for r in got.values():
        p = got.get(r["parent"])
        if r["depth"] > 0:
            assert p["tree_pre"] < r["tree_pre"] and r["tree_last"] <= p["tree_last"]
    return tree


def test_shapes(spark, ws):
    pairs = [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("q", "gone"), (None, "a"), ("b", "a"), ("w", "s")]
    tree = check(spark, ws, pairs)
    assert {r["descendant"] for r in descendants_of(tree, spark.createDataFrame([("b",)], "id string"), ws).collect()} == {"c", "d", "e"}
    assert {(r["ancestor"], r["ancestor_depth"]) for r in ancestors_of(tree, spark.createDataFrame([("e",)], "id string"), ws).collect()} == {("a", 0), ("b", 1), ("d", 2)}
    paths = {r["id"]: r["path"] for r in with_paths(tree, ws).collect()}
    assert paths["e"] == ["a", "b", "d", "e"] and paths["x"] is None and paths["q"] == ["q"]


def test_empty_and_extra_columns(spark, ws):
    assert build_hierarchy(spark.createDataFrame([], SCHEMA), ws).count() == 0
    df = spark.createDataFrame([("a", None, 1, "r"), ("b", "a", 2, "s")], "id string, parent string, depth int, root string")
    assert {(r["id"], r["root"], r["depth"]) for r in build_hierarchy(df, ws).collect()} == {("a", "a", 0), ("b", "a", 1)}


def test_deep_chain_and_hot_parent(spark, ws):
    chain = [(f"n{k:05d}", f"n{k - 1:05d}" if k else None) for k in range(700)]
    star = [(f"s{k:04d}", "n00350") for k in range(300)]
    check(spark, ws, chain + star)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000))
def test_random_forests(spark, ws, seed):
    r = random.Random(seed)
    n = r.randint(1, 60)
    check(spark, ws, [(f"v{k:03d}", r.choice([None, "gone", *[f"v{j:03d}" for j in range(n)]])) for k in range(n)])


def test_prefix_sums(spark, ws):
    df = spark.createDataFrame([(k % 3, k, k + 1) for k in range(50)], "g int, k int, v long")
    got = [r["run"] for r in prefix_sums(ws, df, ["g", "k"], "v", "run").orderBy("g", "k").collect()]
    values = [k + 1 for g in range(3) for k in range(50) if k % 3 == g]
    assert got == [sum(values[:i]) for i in range(50)]


@pytest.mark.parametrize("least", [1, 10**9])
def test_skew_safe_lookup(spark, least):
    from parleyworks.session import skew_safe_lookup

    big = spark.createDataFrame([("h", k) for k in range(40)] + [("a", 1), (None, 2), ("zz", 3)], "k string, v int")
    small = spark.createDataFrame([("h", 1), ("a", 2)], "k string, w int")
    got = sorted(skew_safe_lookup(big, small, "k", "left", share=0.2, least=least).collect(), key=repr)
    assert got == sorted(big.join(small, "k", "left").collect(), key=repr)
    assert skew_safe_lookup(big, small, "k", "inner", share=0.2, least=least).count() == 41


def test_ranges_over_several_tiers(spark, ws):
    """A tree of more nodes than two tiers of blocks hold numbers: descendants and paths of all nodes against brute force."""
    r = random.Random(4)
    pairs = [(f"n{k:05d}", f"n{max(0, k - r.randint(1, 60)):05d}" if k else None) for k in range(4_200)] + [("x", "y"), ("y", "x")]
    tree = ws.save(build_hierarchy(spark.createDataFrame(pairs, SCHEMA), ws), "tree")
    parent = dict(pairs)
    path = {}
    for i, p in pairs[:4_200]:
        path[i] = [*path.get(p, []), i]
    wanted = spark.createDataFrame([(f"n{k:05d}",) for k in range(0, 4_200, 70)] + [("x",), ("no",), ("n00000",)], "id string")
    got = {r["id"]: r["path"] for r in paths_of(tree, wanted, ws).collect()}
    assert got == {f"n{k:05d}": "/".join(path[f"n{k:05d}"]) for k in range(0, 4_200, 70)} | {"x": None}
    below = sorted(map(tuple, descendants_of(tree, wanted, ws).collect()))
    assert below == sorted((w, d, len(p) - len(path[w])) for w in (f"n{k:05d}" for k in range(0, 4_200, 70)) for d, p in path.items() if w in p[:-1])
    assert parent["x"] == "y" and paths_of(tree.limit(0), wanted, ws).count() == 0 and descendants_of(tree, wanted.limit(0), ws).count() == 0


def test_saved_steps_carry_their_figures(spark, ws):
    from pyspark.sql import functions as F

    got = ws.save(spark.range(10).withColumn("odd", F.col("id") % 2 == 1), "step", odd=F.count_if("odd"))
    assert (got.seen["rows"], got.seen["odd"]) == (10, 5)
    none = ws.save(spark.range(10).where("id > 99"), "none", most=F.max("id"))
    assert none.seen["rows"] == 0 and none.seen["most"] is None and none.count() == 0
