"""Parent-child rows to full hierarchies: root, depth, subtree size and nested-set range of each node.

The forest is contracted first: a maximal run of only children becomes one weighted chain, found by list ranking
(pointer doubling), so deep threads cost a logarithmic number of rounds. On the contracted forest subtree sizes are summed
upwards, siblings get adjacent preorder ranges by prefix sums over their sizes, and the ranges are carried downwards.
Nodes that no round reaches hang from a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace, skew_safe_lookup

CYCLE = "cycle"


def prefix_sums(ws: Workspace, df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in the global order of ``order`` (a total order).

    Rows are range-partitioned by the order, so a hot prefix of it is spread over many tasks; only one total per
    partition is brought together.
    """
    ranged = ws.save(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_pid").agg(F.sum(value).alias("_total"))
    before = totals.select("_pid", (F.sum("_total").over(Window.orderBy("_pid")) - F.col("_total")).alias("_before"))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(before), "_pid")
        .withColumn(out, F.col("_before") + F.sum(value).over(inside) - F.col(value))
        .drop("_pid", "_before")
    )


def _rank_chains(ws: Workspace, links: DataFrame) -> DataFrame:
    """links: (nid, ptr) with at most one row per ptr and per nid. Returns (nid, head, dist); rows on pure loops are left out."""
    inner = links.select(F.col("nid").alias("ptr"), F.lit(True).alias("_inner"))
    state = ws.save(
        links.join(inner, "ptr", "left").select("nid", "ptr", F.lit(1).cast("long").alias("dist"), F.col("_inner").isNull().alias("done")),
        "chain", done=F.count_if("done"),
    )
    while state.seen["done"] < state.seen["rows"]:
        active = state.where(~F.col("done"))
        there = state.select(F.col("nid").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"), F.col("done").alias("_done"))
        step = active.join(there, "ptr").select("nid", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done"))
        merged = ws.save(state.where("done").unionByName(step), "chain", done=F.count_if("done"))
        stuck = merged.seen["done"] == state.seen["done"]
        ws.drop(state)
        state = merged
        if stuck:
            break
    return state.where("done").select("nid", F.col("ptr").alias("head"), "dist")


def build_hierarchy(nodes: DataFrame, ws: Workspace, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """One row per distinct non-null id: ``id, parent, root, depth, subtree_size, tree_pre, tree_last``.

    * A node whose parent is null or names no node is a root (root = itself, depth 0).
    * If rows repeat an id, the smallest non-null parent that occurs counts.
    * A node that reaches no root gets root ``cycle``, depth -1 and null ranges.
    * ``tree_pre`` numbers a tree's nodes from 0 in preorder, siblings in order of their id; the descendants of a node
      are those of its root with ``tree_pre`` in (pre, last].
    * Null ids are left out; an empty table gives no rows; other columns are ignored.
    """
    distinct = (
        nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )
    named = ws.save(distinct.withColumn("nid", F.monotonically_increasing_id()), "named")
    ids = named.select(F.col("id").alias("parent"), F.col("nid").alias("par"))
    tree = ws.save(skew_safe_lookup(named.select("nid", "parent"), ids, "parent", rows=named.seen["rows"]).select("nid", "par"), "tree")

    only = (
        tree.where(F.col("par").isNotNull())
        .groupBy("par")
        .agg(F.count("*").alias("n"), F.min("nid").alias("nid"))
        .where("n = 1")
        .select("nid", F.col("par").alias("ptr"))
    )
    links = ws.save(only, "links")
    chained = ws.save(_rank_chains(ws, links), "chained")
    # position of every node in its chain; a loop of only children has neither head nor position
    placed = ws.save(
        tree.join(links.select("nid", F.lit(True).alias("_link")), "nid", "left")
        .join(chained, "nid", "left")
        .where("_link is null or head is not null")
        .select("nid", "par", F.coalesce("head", "nid").alias("head"), F.coalesce("dist", F.lit(0)).cast("long").alias("dist")),
        "placed",
    )
    lengths = placed.groupBy("head").agg((F.max("dist") + 1).alias("len"))
    heads = placed.where("dist = 0").select(F.col("nid").alias("head"), "par").join(lengths, "head")
    above = placed.select(F.col("nid").alias("par"), F.col("head").alias("up"), (F.col("dist") + 1).alias("hop"))
    heads = ws.save(skew_safe_lookup(heads, above, "par", rows=placed.seen["rows"]).select("head", "len", "up", "hop", F.col("par").isNotNull().alias("child")), "heads")

    done_heads = _ranges(ws, heads)
    full = skew_safe_lookup(placed.select("nid", "head", "dist"), done_heads, "head", "inner", rows=placed.seen["rows"])
    numbered = full.select(
        "nid",
        "root",
        (F.col("head_depth") + F.col("dist")).alias("depth"),
        (F.col("head_size") - F.col("dist")).alias("subtree_size"),
        (F.col("head_pre") + F.col("dist")).alias("tree_pre"),
    )
    roots = named.select(F.col("nid").alias("root"), F.col("id").alias("root_id"))
    numbered = ws.save(skew_safe_lookup(numbered, roots, "root", rows=placed.seen["rows"]), "numbered")
    return (
        named.join(numbered, "nid", "left")
        .select(
            "id",
            "parent",
            F.coalesce("root_id", F.lit(CYCLE)).alias("root"),
            F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"),
            "subtree_size",
            "tree_pre",
            (F.col("tree_pre") + F.col("subtree_size") - 1).alias("tree_last"),
        )
    )


def _ranges(ws: Workspace, heads: DataFrame) -> DataFrame:
    """heads: (head, len, up, hop, child). Returns (head, root, head_depth, head_size, head_pre) for heads that reach a root."""
    # upwards: after round k a row knows its ancestor at distance 2**k, the depth on the way, and the size gathered below
    state = ws.save(
        heads.select(
            "head",
            F.coalesce("up", "head").alias("anc"),
            F.coalesce("hop", F.lit(0)).cast("long").alias("way"),
            F.col("len").alias("size"),
            (~F.col("child")).alias("done"),
        ).where("done or anc != head"),
        "up", done=F.count_if("done"),
    )
    while state.seen["done"] < state.seen["rows"]:
        active = state.where(~F.col("done"))
        gained = active.groupBy(F.col("anc").alias("head")).agg(F.sum("size").alias("more"))
        there = state.select(F.col("head").alias("anc"), F.col("anc").alias("_anc"), F.col("way").alias("_way"), F.col("done").alias("_done"))
        step = skew_safe_lookup(active, there, "anc", "inner", rows=state.seen["rows"] - state.seen["done"]).select(
            "head", F.col("_anc").alias("anc"), (F.col("way") + F.col("_way")).alias("way"), "size", F.col("_done").alias("done")
        )
        merged = ws.save(
            state.where("done").unionByName(step).join(gained, "head", "left")
            .select("head", "anc", "way", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), "done"),
            "up", done=F.count_if("done"),
        )
        stuck = merged.seen["done"] == state.seen["done"]
        ws.drop(state)
        state = merged
        if stuck:
            break
    reached = state.where("done").select("head", F.col("anc").alias("root"), F.col("way").alias("head_depth"), F.col("size").alias("head_size"))

    # siblings: adjacent ranges by prefix sums of the sizes, in order of the head's number (that of the ids)
    kids = reached.join(heads.where("child").select("head", "up", "hop"), "head").select("head", "up", "hop", "head_size")
    running = ws.save(prefix_sums(ws, kids, ["up", "head"], "head_size", "run"), "run")
    first = running.groupBy("up").agg(F.min("run").alias("first"))
    # a child chain starts right after the last node of its parent chain (hop) and the ranges of its elder siblings
    start = skew_safe_lookup(running, first, "up", "inner", rows=running.seen["rows"]).select("head", "up", (F.col("hop") + F.col("run") - F.col("first")).alias("off"))

    # downwards: the offsets on the way to the root add up
    down = ws.save(
        reached.select("head").join(start, "head", "left")
        .select("head", F.coalesce("up", "head").alias("anc"), F.coalesce("off", F.lit(0)).alias("pre"), F.col("up").isNull().alias("done")),
        "down", done=F.count_if("done"),
    )
    while down.seen["done"] < down.seen["rows"]:
        there = down.select(F.col("head").alias("anc"), F.col("anc").alias("_anc"), F.col("pre").alias("_pre"), F.col("done").alias("_done"))
        step = skew_safe_lookup(down.where(~F.col("done")), there, "anc", "inner", rows=down.seen["rows"] - down.seen["done"]).select(
            "head", F.col("_anc").alias("anc"), (F.col("pre") + F.col("_pre")).alias("pre"), F.col("_done").alias("done")
        )
        merged = ws.save(down.where("done").unionByName(step), "down", done=F.count_if("done"))
        ws.drop(down)
        down = merged
    return ws.save(reached.join(down.select("head", F.col("pre").alias("head_pre")), "head"), "ranges")


#: Rows of at most a few hundred bytes that may be sent to all tasks.
SMALL = 100_000
#: Ranges are joined by blocks of preorder numbers; a block has a power of this many numbers.
BLOCK_BASE = 64


def _blocks(nodes: DataFrame, first: Column, last: Column) -> DataFrame:
    """Add ``_tier`` and ``_block``: one row per block that the range first..last touches, with blocks of BLOCK_BASE ** tier numbers, no longer
    than the range. So a range has at most BLOCK_BASE + 1 rows, and blocks reach no further beyond it than its own length."""
    length = last - first + 1
    tier = F.floor(F.log(float(BLOCK_BASE), length.cast("double")) + 1e-9).cast("int")
    sized = nodes.where(length > 0).withColumn("_tier", tier).withColumn("_size", F.pow(F.lit(float(BLOCK_BASE)), F.col("_tier")).cast("long"))
    return sized.withColumn("_block", F.explode(F.sequence(F.floor(first / F.col("_size")), F.floor(last / F.col("_size"))))).drop("_size")


def _at_tiers(nodes: DataFrame, at: Column, most: int) -> DataFrame:
    """Add ``_tier`` and ``_block``: one row per tier that ranges of up to ``most`` numbers may have."""
    tiers = [0]
    while BLOCK_BASE ** (tiers[-1] + 1) <= most:
        tiers.append(tiers[-1] + 1)
    places = F.array(*[F.struct(F.lit(t).alias("_tier"), F.floor(at / F.lit(BLOCK_BASE**t)).alias("_block")) for t in tiers])
    return nodes.withColumn("_p", F.explode(places)).select("*", "_p._tier", "_p._block").drop("_p")


def ancestors_of(tree: DataFrame, wanted: DataFrame, ws: Workspace) -> DataFrame:
    """(id, ancestor, ancestor_depth) of each id of ``wanted`` (a column ``id``): the nodes of its tree whose range holds it.

    Ranges meet numbers by blocks of preorder numbers, so pairs of nodes of one tree that aren't related are not made. What is wanted
    is written first: up to ``SMALL`` rows of it go to all tasks, so that nothing else moves; more meet by a shuffle."""
    ok = tree.where("tree_pre is not null")
    most = ok.agg(F.max("subtree_size")).first()[0] or 1  # one number
    w = ws.save(ok.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "root", F.col("tree_pre").alias("_at")), "wanted")
    a = ok.where("tree_last > tree_pre").select(F.col("id").alias("ancestor"), "root", "tree_pre", "tree_last", F.col("depth").alias("ancestor_depth"))
    below = _blocks(a, F.col("tree_pre") + 1, F.col("tree_last"))
    points = _at_tiers(w, F.col("_at"), most)
    points = F.broadcast(points) if w.seen["rows"] <= SMALL else points
    return points.join(below, ["root", "_tier", "_block"]).where(F.col("_at").between(F.col("tree_pre") + 1, F.col("tree_last"))).select("id", "ancestor", "ancestor_depth")


def descendants_of(tree: DataFrame, wanted: DataFrame, ws: Workspace) -> DataFrame:
    """(id, descendant, distance) of each id of ``wanted`` (a column ``id``), by its nested-set range, joined by blocks like ``ancestors_of``."""
    ok = tree.where("tree_pre is not null")
    w = ok.where("tree_last > tree_pre").join(wanted.select("id").distinct(), "id", "left_semi").select("id", "root", F.col("tree_pre").alias("_pre"), F.col("tree_last").alias("_last"), F.col("depth").alias("_depth"))
    w = ws.save(w, "wanted", most=F.max(F.col("_last") - F.col("_pre")))
    most = w.seen["most"] or 1
    d = ok.select(F.col("id").alias("descendant"), "root", "tree_pre", "depth")
    ranges = _blocks(w, F.col("_pre") + 1, F.col("_last"))
    ranges = F.broadcast(ranges) if w.seen["rows"] * (BLOCK_BASE + 1) <= SMALL else ranges
    return _at_tiers(d, F.col("tree_pre"), most).join(ranges, ["root", "_tier", "_block"]).where((F.col("tree_pre") > F.col("_pre")) & (F.col("tree_pre") <= F.col("_last"))).select("id", "descendant", (F.col("depth") - F.col("_depth")).alias("distance"))


def paths_of(tree: DataFrame, wanted: DataFrame, ws: Workspace, separator: str = "/") -> DataFrame:
    """(id, path) of each id of ``wanted`` that is in ``tree``: the ids from its root to itself; null for nodes on or below a loop.

    A path is one value of a row, as long as its node is deep."""
    up = ancestors_of(tree, wanted, ws).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ancestor_depth", "ancestor"))), lambda a: a["ancestor"]), separator).alias("_up"))
    own = tree.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "depth")
    return own.join(up, "id", "left").select("id", F.when(F.col("depth") >= 0, F.concat_ws(separator, "_up", "id")).alias("path"))


def with_paths(tree: DataFrame, ws: Workspace) -> DataFrame:
    """Add ``path``: the ids from the root to the node, by doubling; null for nodes on or below a loop. The output is as large as all paths together."""
    ok = tree.where("depth >= 0")
    state = ws.save(
        ok.select("id", F.when(F.col("depth") > 0, F.col("parent")).alias("anc"), F.array("id").alias("path")), "path"
    )
    while state.where("anc is not null").limit(1).count():
        there = state.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("path").alias("_path"))
        merged = ws.save(
            state.join(there, "anc", "left").select("id", F.col("_anc").alias("anc"), F.when(F.col("_path").isNotNull(), F.concat("_path", "path")).otherwise(F.col("path")).alias("path")), "path"
        )
        ws.drop(state)
        state = merged
    return tree.join(state.select("id", "path"), "id", "left")
