"""Mixing sources to target shares of the total size.

Sizes are tokens of a public tokenizer. Each source is cut into blocks of about equal tokens, its documents in a seeded order,
by a distributed prefix sum, so a block is a run of whole documents; blocks are numbered without gaps and dealt to the shards.
The total is the largest for which no source has to repeat more often than it may; its tokens are apportioned among the sources by
Sainte-Lague's highest quotients, and what a source's quota has beyond whole passes among its shards in the same way. A shard's
documents are then chosen in the order of their blocks as far as they fit; what a shard leaves over goes to the next.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hierarchy import prefix_sums
from ..session import Workspace

#: Tokens of a block, shards of a source, and the seed of the order.
BLOCK_TOKENS = 2_000
SHARDS = 4
SEED = 11


def sainte_lague(shares: dict[str, float], seats: int, most: dict[str, int] | None = None) -> dict[str, int]:
    """Whole numbers that add up to ``seats`` (or to the caps, if they are less): the highest quotients share / (2 n + 1) win.

    Ties go to the larger share, then to the name. A name whose share is not above 0 gets none.
    """
    got = {s: 0 for s in shares}
    heap = [(-v, -v, s) for s, v in shares.items() if v > 0 and (most is None or most.get(s, 0) > 0)]
    heapq.heapify(heap)
    left = seats
    # a first whole part for all keeps the number of steps at about the number of names
    total = sum(shares[s] for _, _, s in heap)
    if total > 0 and seats > 4 * len(heap):
        for k, (_, v, s) in enumerate(heap):
            n = max(0, int(seats * -v / total) - 2)
            n = min(n, most[s]) if most is not None else n
            got[s] = n
            left -= n
        heap = [(-shares[s] / (2 * got[s] + 1), v, s) for _, v, s in heap if most is None or got[s] < most[s]]
        heapq.heapify(heap)
    while left > 0 and heap:
        _, v, s = heapq.heappop(heap)
        got[s] += 1
        left -= 1
        if most is None or got[s] < most[s]:
            heapq.heappush(heap, (v / (2 * got[s] + 1), v, s))
    return got


def with_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``tokens``: the number of tokens of ``text`` by the byte-level BPE whose ranks are in the file ``vocabulary``.

    The file is read on the driver and sent to the executors, as large as the vocabulary; it needs to be nowhere else. Null and empty texts have 0. Strings of special tokens count as ordinary text.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text) + ", tokens bigint"
    others = [c for c in docs.columns if c != text]
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        # Fixed value: the published split pattern of this vocabulary.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in held.value.splitlines() if line.strip())}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for p in parts:
            yield p[others].assign(tokens=[len(coder.encode_ordinary(t)) if t else 0 for t in p[text]])

    return docs.mapInPandas(run, schema)


def cut_blocks(docs: DataFrame, ws: Workspace, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(source, doc_id, tokens, at, block): documents of a source in seeded order, at = tokens before the document, block = at / block size.

    Where a document is longer than a block, numbers of blocks are left out."""
    ordered = docs.select("source", "doc_id", "tokens", F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("place"))
    summed = ws.save(prefix_sums(ws, ordered, ["source", "place", "doc_id"], "tokens", "before"), "summed")
    first = summed.groupBy("source").agg(F.min("before").alias("first"))
    at = F.col("before") - F.col("first")
    return summed.join(F.broadcast(first), "source").select("source", "doc_id", "tokens", at.alias("at"), F.floor(at / block_tokens).cast("long").alias("block"))


def dealt(blocks: DataFrame, ws: Workspace, shards: int = SHARDS) -> DataFrame:
    """(source, doc_id, tokens, block, shard, place): blocks numbered from 0 without gaps in each source, shard = number modulo ``shards``,
    place = tokens of the shard before the document, which tells a shard's documents apart."""
    per_block = blocks.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.min("at").alias("start"), F.lit(1).alias("one"))
    counted = ws.save(prefix_sums(ws, per_block, ["source", "block"], "one", "number"), "counted")
    first = counted.groupBy("source").agg(F.min("number").alias("first"))
    numbered = counted.join(F.broadcast(first), "source").withColumn("shard", F.pmod(F.col("number") - F.col("first"), F.lit(shards)).cast("int")).drop("first", "one")
    summed = ws.save(prefix_sums(ws, numbered, ["source", "shard", "number"], "size", "before"), "dealt")
    least = summed.groupBy("source", "shard").agg(F.min("before").alias("least"))
    starts = summed.join(F.broadcast(least), ["source", "shard"]).select("source", "block", "shard", "start", (F.col("before") - F.col("least")).alias("before"))
    return blocks.join(starts, ["source", "block"]).select("source", "doc_id", "tokens", "block", "shard", (F.col("before") + F.col("at") - F.col("start")).alias("place"))


def fits(place: str, limit: str) -> Column:
    """Whether a document ends within ``limit``."""
    return F.col(place) + F.col("tokens") <= F.col(limit)


def filled(placed: DataFrame, left: dict[str, int], quota: dict[str, int], ws: Workspace) -> DataFrame | None:
    """(source, shard, place, further) of documents among ``placed`` that fill what is ``left`` of the quotas; None where none is needed.

    A document longer than what is left would end the running sum of its source, so it is passed over, again as long as more than a
    hundredth of the quota is left and a document fits. Where none fits any more the shortest is taken if that comes nearer to the quota."""
    spark, chosen = ws.spark, None

    def free(want: list[tuple[str, int]], most: int) -> DataFrame:
        wanted = spark.createDataFrame(want, "source string, limit bigint")
        rest = placed.join(F.broadcast(wanted), "source").where(F.col("tokens") <= most * F.col("limit"))
        return rest if chosen is None else rest.join(chosen, ["source", "shard", "place"], "left_anti")

    open_ = set(left)
    while want := [(s, n) for s, n in left.items() if s in open_ and n * 100 > quota[s]]:
        run = ws.save(prefix_sums(ws, free(want, 1), ["source", "block", "place"], "tokens", "sum"), "free")
        first = run.groupBy("source").agg(F.min("sum").alias("first"))
        got = ws.save(run.join(F.broadcast(first), "source").withColumn("run", F.col("sum") - F.col("first")).where(fits("run", "limit")).select("source", "shard", "place", "tokens", F.lit(1).alias("further")), "filled")
        taken = {r["source"]: r["tokens"] for r in got.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
        open_ = set(taken)
        left = {s: n - taken.get(s, 0) for s, n in left.items()}
        if taken:
            chosen = got.drop("tokens") if chosen is None else chosen.unionByName(got.drop("tokens"))
    if want := [(s, n) for s, n in left.items() if n * 100 > quota[s]]:
        least = free(want, 2).groupBy("source").agg(F.min(F.struct("tokens", "shard", "place")).alias("least"))
        got = ws.save(least.select("source", "least.shard", "least.place", F.lit(1).alias("further")), "filled")
        chosen = got if chosen is None else chosen.unionByName(got)
    return chosen


def mixed(docs: DataFrame, targets: DataFrame, ws: Workspace, vocabulary: str, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    docs: doc_id, source, text; targets: source, target_share, max_repeats. Sources are compared without letter case and
    surrounding blanks. Shares are taken relative to their sum over the sources that have documents; a source without a target or
    without documents gets nothing and is reported so; ``max_repeats`` is how often each of a source's documents may occur, at least
    once. Documents without tokens are left out.

    selection: (source, doc_id, pass) - a document occurs once per pass. report: per source target_share, wanted_share (relative),
    actual_share, tokens, tokens_available, blocks, quota (in tokens), repeats. Tokens differ
    from the quota by at most a hundredth of it, or by what no further whole document brings nearer.
    """
    spark = ws.spark
    name = lambda c: F.lower(F.btrim(F.col(c)))
    # one row per source that has a target: as many as the target table has rows
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select(name("source").alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null and target_share > 0").collect()}
    named = docs.select("doc_id", name("source").alias("source"), "text").where(F.col("source").isin(list(wanted)))
    sized = ws.save(with_tokens(named, vocabulary), "tokens")
    blocks = ws.save(cut_blocks(sized.where("tokens > 0"), ws, block_tokens, seed), "blocks")
    placed = ws.save(dealt(blocks, ws, shards), "placed")
    # one row per source and shard
    per_shard = {(r["source"], r["shard"]): (r["blocks"], r["tokens"]) for r in placed.groupBy("source", "shard", "block").agg(F.sum("tokens").alias("tokens")).groupBy("source", "shard").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens")).collect()}
    have = {s: tuple(sum(v[k] for (o, _), v in per_shard.items() if o == s) for k in (0, 1)) for s in {s for s, _ in per_shard}}
    usable = {s: v for s, v in wanted.items() if s in have}
    total_share = sum(v[0] for v in usable.values())
    shares = {s: v[0] / total_share for s, v in usable.items()}
    most = {s: have[s][1] * max(1, usable[s][1]) for s in usable}
    # the largest total that no source has to repeat too often for
    seats = int(min((most[s] / shares[s] for s in shares), default=0))
    quota = sainte_lague(shares, seats, most)
    full, part = {}, {}
    for s, q in quota.items():
        full[s], rest = divmod(q, have[s][1])
        # what a further pass takes is apportioned among the shards by their tokens
        by_shard = {str(k): per_shard[s, k][1] for k in range(shards) if (s, k) in per_shard}
        part |= {(s, int(k)): n for k, n in sainte_lague({k: float(v) for k, v in by_shard.items()}, rest, by_shard).items()}
    left = dict.fromkeys(quota, 0)
    plan = []
    for k in range(shards):
        limits = [(s, k, full[s], left[s] + n) for (s, j), n in sorted(part.items()) if j == k]
        now = spark.createDataFrame(limits or [], "source string, shard int, full bigint, limit bigint")
        taken = placed.join(F.broadcast(now), ["source", "shard"]).where(fits("place", "limit")).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect() if any(n > 0 for *_, n in limits) else []
        left |= {s: n for s, _, _, n in limits}
        for r in taken:
            left[r["source"]] -= r["tokens"]
        plan += limits
    plans = spark.createDataFrame(plan or [], "source string, shard int, full bigint, limit bigint")
    first = placed.join(F.broadcast(plans), ["source", "shard"]).withColumn("passes", F.col("full") + fits("place", "limit").cast("int"))
    more = filled(first.where(F.col("passes") == F.col("full")).drop("full", "limit", "passes"), left, quota, ws)
    if more is not None:
        first = first.join(more, ["source", "shard", "place"], "left").withColumn("passes", F.col("passes") + F.coalesce("further", F.lit(0)))
    chosen = first.where("passes > 0").withColumn("passes", F.col("passes").cast("int"))
    selection = chosen.select("source", "doc_id", F.explode(F.sequence(F.lit(1), "passes")).alias("pass"))
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("passes")).alias("tokens"), F.max("passes").alias("repeats"))
    rows = [(s, w[0], float(shares.get(s, 0.0)), have[s][1] if s in have else 0, have[s][0] if s in have else 0, int(quota.get(s, 0)), int(w[1])) for s, w in sorted(wanted.items())]
    base = spark.createDataFrame(rows or [], "source string, target_share double, wanted_share double, tokens_available bigint, blocks bigint, quota bigint, max_repeats int")
    joined = base.join(taken, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = Window.partitionBy(F.lit(1))
    report = joined.select(
        "source", "target_share", "wanted_share", F.round(F.col("tokens") / F.sum("tokens").over(whole), 6).alias("actual_share"), "tokens", "tokens_available", "blocks", "quota",
        F.coalesce("repeats", F.lit(0)).cast("int").alias("repeats"), "max_repeats",
    )
    return selection, report
