"""Consolidating pairwise matches into groups.

The graph of links is reduced until nothing cheap is left to take away: vertices with one link are stripped and hooked to
their neighbour, and runs of vertices with two links are replaced by one link between their ends, found by list ranking
(pointer doubling from either side). Both together shrink a tree by a constant factor a round. What remains, the core, is
solved by alternating large-star and small-star steps; then every removed vertex takes over the label of the vertex it
hooks to, by doubling along the hooks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace, skew_safe_lookup

#: A reduction round that takes away less than this share of the links hands over to the core solver.
MIN_SHRINK = 0.05


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("e")).select("e.v", "e.n")


def _degrees(edges: DataFrame) -> DataFrame:
    """(v, deg, n1, n2): n1 and n2 are the smallest and largest neighbour. Hubs are combined on the map side."""
    return _both_ways(edges).groupBy("v").agg(F.count("*").alias("deg"), F.min("n").alias("n1"), F.max("n").alias("n2"))


def _without(edges: DataFrame, gone: DataFrame, rows: int) -> DataFrame:
    """Links none of whose ends is in ``gone`` (column v); ``rows`` is how many links there are."""
    for end in ("a", "b"):
        flag = gone.select(F.col("v").alias(end), F.lit(True).alias("_gone"))
        edges = skew_safe_lookup(edges, flag, end, rows=rows).where("_gone is null").drop("_gone")
    return edges


def _rank(ws: Workspace, twos: DataFrame) -> DataFrame:
    """twos: (v, n1, n2). Returns (v, t1, t2, least): the ends of the chain of v, or nulls and the least vertex where it is a ring."""
    arcs = twos.select(F.explode(F.array(F.struct(F.col("n1").alias("x"), F.col("v"), F.col("n2").alias("y")), F.struct(F.col("n2").alias("x"), F.col("v"), F.col("n1").alias("y")))).alias("e")).select("e.*")
    inside = twos.select(F.col("v").alias("y"), F.lit(True).alias("_in"))
    # an arc enters v from x; it goes on from v into y. (p, q) is the arc that it points to, end is set when that has left the chain
    state = ws.save(
        arcs.join(inside, "y", "left").select(
            "x", "v", F.when(F.col("_in"), F.col("v")).alias("p"), F.when(F.col("_in"), F.col("y")).alias("q"), F.when(F.col("_in").isNull(), F.col("y")).alias("end"), F.least("v", "y").alias("least"), F.lit(True).alias("new")
        ),
        "arcs", open=F.count_if(F.col("end").isNull()),
    )
    # arcs of a ring never end: as soon as a step over twice as many arcs tells none of them a lesser vertex, they know their least one
    while state.seen["open"]:
        there = state.select(F.col("x").alias("p"), F.col("v").alias("q"), F.col("p").alias("_p"), F.col("q").alias("_q"), F.col("end").alias("_end"), F.col("least").alias("_least"))
        ahead = state.where(F.col("end").isNull()).join(there, ["p", "q"]).select(
            "x", "v", F.col("_p").alias("p"), F.col("_q").alias("q"), F.col("_end").alias("end"), F.least("least", "_least").alias("least"), (F.col("_end").isNotNull() | (F.col("_least") < F.col("least"))).alias("new")
        )
        step = ws.save(state.where(F.col("end").isNotNull()).withColumn("new", F.lit(False)).unionByName(ahead), "arcs", open=F.count_if(F.col("end").isNull()), new=F.count_if("new"))
        ws.drop(state)
        state = step
        if not state.seen["new"]:
            break
    return state.groupBy("v").agg(F.min("end").alias("t1"), F.max("end").alias("t2"), F.min("least").alias("least"))


def _core(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(v, label) of the vertices of any graph: alternating large and small stars until nothing changes."""
    state = ws.save(edges, "core")
    while True:
        both = _both_ways(state)
        least = both.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = skew_safe_lookup(both, least, "v", "inner", rows=2 * state.seen["rows"]).where("n > v and n != m").select(F.col("m").alias("a"), F.col("n").alias("b"), (F.col("m") < F.col("v")).alias("moved"))
        large = ws.save(large.groupBy("a", "b").agg(F.max("moved").alias("moved")), "large", moved=F.count_if("moved"))
        down = large.select(F.col("b").alias("v"), F.col("a").alias("n"))
        small_least = down.groupBy("v").agg(F.min("n").alias("m"), F.count("*").alias("tops"))
        joined = skew_safe_lookup(down, small_least, "v", "inner", rows=large.seen["rows"])
        ends = F.array(F.struct(F.col("m").alias("a"), F.col("n").alias("b")), F.struct(F.col("m").alias("a"), F.col("v").alias("b")))
        small = joined.select(F.explode(ends).alias("e"), (F.col("tops") > 1).alias("moved")).select("e.*", "moved").where("a != b")
        small = ws.save(small.groupBy("a", "b").agg(F.max("moved").alias("moved")), "small", moved=F.count_if("moved"))
        ws.drop(state, large)
        state = small
        # no vertex but the least of its neighbours has a larger neighbour, and none hangs from two: all are stars
        if not large.seen["moved"] and not small.seen["moved"]:
            return state.select(F.col("b").alias("v"), F.col("a").alias("label"))


def connected_groups(links: DataFrame, ws: Workspace) -> DataFrame:
    """(id, group) of every id that has a link: ``group`` is the least id that it reaches.

    links: columns ``a`` and ``b``. Repeated and reversed pairs count once; pairs with a null end or of an id with itself
    are no links, and an id that has no others is left out. An empty table gives no rows.
    """
    edges = ws.save(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    hooks: list[DataFrame] = []
    count = edges.seen["rows"]
    while count:
        degrees = ws.save(_degrees(edges), "degrees")
        # of two vertices that have only each other the smaller one stays
        pairs = degrees.where("deg = 1")
        other = degrees.select(F.col("v").alias("n1"), F.col("deg").alias("_deg"))
        leaves = ws.save(skew_safe_lookup(pairs, other, "n1", "inner", rows=min(degrees.seen["rows"], 2 * count)).where("_deg > 1 or n1 < v").select("v", F.col("n1").alias("to")), "leaves")
        hooks.append(leaves)
        stripped = ws.save(_without(edges, leaves, count), "stripped")
        ws.drop(degrees, edges)
        twos = ws.save(_degrees(stripped).where("deg = 2").select("v", "n1", "n2"), "twos")
        edges = stripped
        if twos.seen["rows"]:
            chains = ws.save(_rank(ws, twos), "chains")
            # a ring hooks to its least vertex, a chain to the smaller of its ends
            hooks.append(ws.save(chains.select("v", F.coalesce("t1", "least").alias("to")).where("v != to"), "hooks"))
            joins = chains.where("t1 != t2").select(F.col("t1").alias("a"), F.col("t2").alias("b"))
            edges = ws.save(_without(stripped, chains.select("v"), stripped.seen["rows"]).unionByName(joins).distinct(), "edges")
            ws.drop(stripped, twos)
        left = edges.seen["rows"]
        if left > (1 - MIN_SHRINK) * count:
            hooks.append(ws.save(_core(ws, edges).select("v", F.col("label").alias("to")), "solved"))
            break
        count = left
    if not hooks:
        return links.select(F.col("a").alias("id"), F.col("b").alias("group")).limit(0)

    up = hooks[0]
    for h in hooks[1:]:
        up = up.unionByName(h)
    up = ws.save(up, "up")
    rows = up.seen["rows"]
    while True:
        there = up.select(F.col("v").alias("to"), F.col("to").alias("_to"))
        new = ws.save(skew_safe_lookup(up, there, "to", rows=rows).select("v", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "up", moved=F.count_if("moved"))
        ws.drop(up)
        up = new.select("v", "to")
        up.saved_at = new.saved_at
        if not new.seen["moved"]:
            break
    # the vertices that nothing hooks away are the groups' tops
    least = up.groupBy("to").agg(F.min("v").alias("_least")).select("to", F.least("to", "_least").alias("group"))
    least = ws.save(least, "least")
    return skew_safe_lookup(up, least, "to", "inner", rows=rows).select(F.col("v").alias("id"), "group").unionByName(least.select(F.col("to").alias("id"), "group"))
