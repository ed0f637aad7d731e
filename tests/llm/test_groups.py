import random

import pytest

from parleyworks.llm.components import _core, connected_groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return sorted((x, min(g)) for g in groups.values() for x in g)


def run(spark, ws, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return sorted(tuple(r) for r in connected_groups(df, ws).select("id", "group").collect())


def test_shapes(spark, ws):
    path = [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(70)]
    ring = [(f"r{k:02d}", f"r{(k + 1) % 9:02d}") for k in range(9)]
    star = [("s", f"t{k}") for k in range(12)]
    clique = [(f"k{i}", f"k{j}") for i in range(6) for j in range(i)]
    odd = [("x", "x"), (None, "y"), ("y", None), ("a", "b"), ("b", "a"), ("a", "b"), ("p003", "k1"), ("m", "n")]
    pairs = path + ring + star + clique + odd
    random.Random(3).shuffle(pairs)
    assert run(spark, ws, pairs) == brute(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, ws, seed):
    r = random.Random(seed)
    pairs = [(f"v{r.randrange(60):02d}", f"v{r.randrange(60):02d}") for _ in range(r.choice([40, 90]))]
    assert run(spark, ws, pairs) == brute(pairs)


def test_core_alone(spark, ws):
    r = random.Random(5)
    pairs = {tuple(sorted((f"v{a:02d}", f"v{b:02d}"))) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(70)) if a != b}
    got = _core(ws, spark.createDataFrame(sorted(pairs), "a string, b string"))
    labels = {x["v"]: x["label"] for x in got.collect()}
    assert all(labels.get(i, i) == g for i, g in brute(pairs))


def test_empty(spark, ws):
    assert run(spark, ws, []) == [] and run(spark, ws, [("a", "a"), (None, None)]) == []
