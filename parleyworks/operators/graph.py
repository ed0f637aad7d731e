"""The graph of facts: bounded traversal, conflicts, orphans, duplicates of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edge_key
from ..schema import SYMMETRIC
from ..session import Workspace, skew_safe_lookup

# The weight of an edge that questions a fact, and the order in which edges of one neighbour are tried.
WEAK = ["CONTRADICTS", "SUPERSEDES"]
WEAK_WEIGHT = 0.7
ORDER = {"CONTRADICTS": 0, "SUPERSEDES": 1, "SUPPORTS": 2}


def neighbours(edges: DataFrame) -> DataFrame:
    """Edges from either end: (id, other, relation_type, created_at, incoming)."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "relation_type", "created_at", F.lit(0).alias("incoming"))
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "relation_type", "created_at", F.lit(1).alias("incoming"))
    return out.unionByName(back)


def related(seeds: DataFrame, edges: DataFrame, facts: DataFrame, ws: Workspace, hops: int = 2, decay: float = 0.6, floor: float = 0.2) -> DataFrame:
    """(seed, id, hop, relevance, relation_type): what each seed reaches within ``hops`` steps over active facts, either way.

    The relevance of a step is decay to the power of its number from 0, times 0.7 for edges that question a fact; a step below the
    floor isn't taken. Each fact is reached once, at its first hop, from the smallest predecessor; of several edges to it the first that
    clears the floor counts: contradictions, then replacements, then support, then others, outgoing ones and older ones first.
    """
    active = facts.where("is_active").select(F.col("id").alias("other"))
    kind = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])
    steps = neighbours(edges).where("id != other").join(active, "other", "left_semi").withColumn("place", F.coalesce(kind[F.col("relation_type")], F.lit(3)))
    steps = ws.save(steps, "steps")
    seen = ws.save(seeds.select(F.col("id").alias("seed"), "id").distinct(), "seen")
    frontier, out = seen, None
    for hop in range(hops):
        base = decay**hop
        if base < floor:
            break
        relevance = F.when(F.col("relation_type").isin(WEAK), base * WEAK_WEIGHT).otherwise(F.lit(base))
        # a hub's steps are many rows of one key: adaptive execution splits them
        reach = frontier.join(steps, "id").withColumn("relevance", relevance).where(F.col("relevance") >= floor)
        new = reach.join(seen.select("seed", F.col("id").alias("other")), ["seed", "other"], "left_anti")
        first = new.groupBy("seed", "other").agg(F.min(F.struct("id", "incoming", "place", "created_at", "relation_type", "relevance")).alias("e"))
        found = ws.save(first.select("seed", F.col("other").alias("id"), F.lit(hop + 1).alias("hop"), F.round("e.relevance", 6).alias("relevance"), "e.relation_type"), "hop")
        out = found if out is None else out.unionByName(found)
        frontier = found.select("seed", "id")
        seen = seen.select("seed", "id").unionByName(frontier)
    return out if out is not None else seen.limit(0).select("seed", "id", F.lit(0).alias("hop"), F.lit(0.0).alias("relevance"), F.lit("").alias("relation_type"))


def active_pairs(edges: DataFrame, facts: DataFrame, kind: str) -> DataFrame:
    """Edges of a kind whose ends are both active, with their texts."""
    a = facts.where("is_active").select(F.col("id").alias("source_id"), F.col("fact").alias("source_fact"))
    b = facts.where("is_active").select(F.col("id").alias("target_id"), F.col("fact").alias("target_fact"))
    return edges.where(F.col("relation_type") == kind).join(a, "source_id").join(b, "target_id")


def orphans(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Active facts without an edge on either side: the ends of edges are listed once, then one anti join."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return facts.where("is_active").join(ends, "id", "left_anti")


def consistency_counts(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: active facts, active conflicts and replacements, orphans and their share, categories of one fact."""
    single = facts.where("is_active and category_id is not null").groupBy("category_id").count().agg(F.count_if(F.col("count") == 1).alias("n"))
    parts = {
        "active": facts.where("is_active").agg(F.count("*").alias("n")),
        "contradicts": active_pairs(edges, facts, "CONTRADICTS").agg(F.count("*").alias("n")),
        "supersedes": active_pairs(edges, facts, "SUPERSEDES").agg(F.count("*").alias("n")),
        "orphans": orphans(facts, edges).agg(F.count("*").alias("n")),
        "single_fact_categories": single,
    }
    rows = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("what"), "n")
        rows = part if rows is None else rows.unionByName(part)
    out = rows.agg(*[F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in parts])
    return out.withColumn("orphan_rate", F.round(F.when(F.col("active") > 0, F.col("orphans") / F.col("active")).otherwise(0.0), 6))


def new_edges(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed edges that aren't there yet, each once: equal triples, or either direction of a kind without one; no self-loops."""
    key = edge_key("relation_type", "source_id", "target_id", SYMMETRIC)
    fresh = proposed.where("source_id != target_id").withColumn("_key", key).dropDuplicates(["_key"])
    return fresh.join(existing.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def edge_duplicates(edges: DataFrame, id_col: str = "rel_id") -> DataFrame:
    """Edges that repeat a triple, but for the one with the least id."""
    key = F.concat_ws("|", "source_id", "relation_type", "target_id")
    first = edges.groupBy(key.alias("_key")).agg(F.min(id_col).alias("_first"))
    return skew_safe_lookup(edges.withColumn("_key", key), first, "_key", "inner").where(F.col(id_col) != F.col("_first")).drop("_key", "_first")


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last row of the log for each relation."""
    return log.groupBy("relation_id").agg(F.max_by(F.struct("id", "action", "verdict", "confidence"), "id").alias("r")).select("relation_id", "r.*")


def tombstoned(log: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs whose last decision removed the relation and whose facts still read as then: a text that wasn't recorded or a fact that is gone doesn't matter."""
    last = log.groupBy("source_fact_id", "target_fact_id", "relation_type_before").agg(F.max_by(F.struct("id", "action", "source_fact", "target_fact"), "id").alias("r")).select("source_fact_id", "target_fact_id", "relation_type_before", "r.*").where(F.col("action").isin("delete", "retype"))
    a = facts.select(F.col("id").alias("source_fact_id"), F.col("fact").alias("source_now"))
    b = facts.select(F.col("id").alias("target_fact_id"), F.col("fact").alias("target_now"))
    same = lambda then, now: F.col(then).isNull() | F.col(now).isNull() | (F.col(then) == F.col(now))
    return last.join(a, "source_fact_id", "left").join(b, "target_fact_id", "left").where(same("source_fact", "source_now") & same("target_fact", "target_now")).select("source_fact_id", "target_fact_id", "relation_type_before", "action")


def merge_candidates(similar: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of categories at least ``threshold`` alike, each once, with the one that stays: more facts, then the smaller id.

    similar: (query_id, item_id, cosine); sizes: (category_id, domain_id, facts).
    """
    pair = similar.where((F.col("cosine") >= threshold) & (F.col("query_id") != F.col("item_id"))).select(F.least("query_id", "item_id").alias("a"), F.greatest("query_id", "item_id").alias("b"), "cosine")
    once = pair.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    left = sizes.select(F.col("category_id").alias("a"), F.col("domain_id").alias("a_domain"), F.col("facts").alias("a_facts"))
    right = sizes.select(F.col("category_id").alias("b"), F.col("domain_id").alias("b_domain"), F.col("facts").alias("b_facts"))
    both = once.join(left, "a").join(right, "b")
    stays = F.when(F.col("b_facts") > F.col("a_facts"), F.col("b")).otherwise(F.col("a"))
    return both.select(stays.alias("keep"), F.when(stays == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("drop"), "cosine", (F.col("a_domain") == F.col("b_domain")).alias("same_domain"))


def apply_merges(facts: DataFrame, merges: DataFrame, ws: Workspace) -> DataFrame:
    """Facts with the categories of same-domain merges replaced; chains of merges go to their end.

    Chains are resolved by doubling, each step written, in no more rounds than twice the logarithm of their number. Merges that run in
    a loop have no end: their categories, and what leads there, go to the least category of the loop.
    """
    one = merges.where("same_domain").groupBy(F.col("drop").alias("category_id")).agg(F.min("keep").alias("to"))
    step = ws.save(one.withColumn("least", F.col("to")).withColumn("on", F.lit(True)), "merges")
    for _ in range(step.seen["rows"].bit_length() + 1):
        again = step.select(F.col("category_id").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        moved = F.col("_to").isNotNull()
        step = ws.save(step.select("category_id", "to", "least").join(again, "to", "left").select("category_id", F.coalesce("_to", "to").alias("to"), F.least("least", F.coalesce("_least", "least")).alias("least"), moved.alias("on")), "merges", on=F.count_if("on"))
        if not step.seen["on"]:
            break
    # what still moves after so many rounds is in a loop, whose least member each of its members knows
    ends = step.join(step.where("on").select(F.col("category_id").alias("to"), F.col("least").alias("_end")), "to", "left").select("category_id", F.coalesce("_end", "to").alias("to"))
    return facts.join(ends, "category_id", "left").withColumn("category_id", F.coalesce("to", "category_id")).drop("to")


def ontology_tree(facts: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per domain with its categories and their active facts, nested and in order."""
    counts = facts.where("is_active and category_id is not null").groupBy("category_id").agg(F.count("*").alias("facts"))
    return categories.join(counts, "category_id", "left").groupBy("domain_id").agg(F.array_sort(F.collect_list(F.struct("category_id", F.coalesce("facts", F.lit(0)).alias("facts")))).alias("categories"))


def provenance(facts: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(id, place, exchange_id, project, timestamp): the exchanges that a fact came from, in order; those gone are left out."""
    src = facts.select("id", F.posexplode("source_exchange_ids").alias("place", "exchange_id"))
    return src.join(exchanges.select(F.col("id").alias("exchange_id"), "project", "timestamp"), "exchange_id").select("id", "place", "exchange_id", "project", "timestamp")


def ontology_view(facts: DataFrame, categories: DataFrame, edges: DataFrame, needle: str, limit: int = 40) -> DataFrame:
    """Categories whose name contains ``needle`` without letter case, with their active facts and the relations these have; at most ``limit``."""
    chosen = categories.where(F.contains(F.lower("category_id"), F.lit(needle.lower()))).orderBy("category_id").limit(limit)
    inside = facts.where("is_active").join(chosen.select("category_id"), "category_id", "left_semi").select("id", "category_id")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    counts = inside.join(ends.groupBy("id").agg(F.count("*").alias("relations")), "id", "left").groupBy("category_id").agg(F.count("*").alias("facts"), F.sum(F.coalesce("relations", F.lit(0))).alias("relations"))
    return chosen.join(counts, "category_id", "left").select("domain_id", "category_id", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("relations", F.lit(0)).alias("relations"))


def named_without_case(asked: DataFrame, named: DataFrame, name: str, id_col: str) -> DataFrame:
    """``asked`` with the rows of ``named`` whose name is the same without letter case."""
    return asked.withColumn("_low", F.lower(name)).join(named.withColumn("_low", F.lower(id_col)), "_low").drop("_low")


def reused(similarity: Column, category: Column, least: float, other: str) -> Column:
    """The nearest category where it is at least so similar, else the one for all others."""
    return F.when(similarity >= least, category).otherwise(F.lit(other))


def annotated(hits: DataFrame, categories: DataFrame, revisions: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts (id, category_id, ...) with their domain, their number of ``revisions``, of ``relations`` in either direction, and of ``conflicts``."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"), (F.col("relation_type") == "CONTRADICTS").cast("int").alias("c"))
    counts = ends.groupBy("id").agg(F.count("*").alias("relations"), F.sum("c").alias("conflicts"))
    both = hits.join(categories.select("category_id", "domain_id"), "category_id", "left").join(revisions.select("id", "revisions"), "id", "left").join(counts, "id", "left")
    return both.select(*hits.columns, "domain_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("revisions", "relations", "conflicts")])
