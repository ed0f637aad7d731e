"""Facts over time: inserting, rewriting, retiring, consolidating; every change is a new table, with its revisions beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable
from ..session import Workspace, skew_safe_lookup


def deactivated(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Facts with those of ``gone`` (id) inactive."""
    return facts.join(gone.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def rewritten(facts: DataFrame, changes: DataFrame, now: str, place: str = "place") -> tuple[DataFrame, DataFrame]:
    """(facts, revisions) after ``changes`` (id, new_fact, reason, and ``place``, their order): the last text of an id in the batch counts,
    with its own reason (of two at one place the greater text); equal texts change nothing."""
    last = F.max_by(F.struct("new_fact", "reason"), F.struct(place, "new_fact", F.coalesce("reason", F.lit("")))).alias("_last")
    one = changes.where("new_fact is not null").groupBy("id").agg(last).select("id", "_last.new_fact", "_last.reason")
    j = facts.join(one, "id", "left").withColumn("_new", F.col("new_fact").isNotNull() & ~F.col("new_fact").eqNullSafe(F.col("fact")))
    revisions = j.where("_new").select(F.col("id").alias("fact_id"), F.col("fact").alias("previous_fact"), "new_fact", "reason", F.lit(now).alias("created_at"))
    out = j.withColumn("fact", F.when(F.col("_new"), F.col("new_fact")).otherwise(F.col("fact"))).withColumn("updated_at", F.when(F.col("_new"), F.lit(now)).otherwise(F.col("updated_at"))).drop("new_fact", "reason", "_new")
    return out, revisions


def consolidated(facts: DataFrame, verdicts: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(facts, revisions) after ``verdicts`` (old_id, new_id, verdict, merged), in order of the new facts' ids: a duplicate confirms the old fact and retires the new one;
    a contradiction retires the old one; an evolution rewrites the old one, confirms it and retires the new one; others change nothing."""
    old = verdicts.groupBy(F.col("old_id").alias("id")).agg(F.count_if(F.col("verdict").isin("DUPLICATE", "EVOLUTION")).alias("more"), F.bool_or(F.col("verdict") == "CONTRADICTION").alias("out"))
    new = verdicts.where(F.col("verdict").isin("DUPLICATE", "EVOLUTION")).select(F.col("new_id").alias("id"), F.lit(True).alias("merged_away")).distinct()
    j = facts.join(old, "id", "left").join(new, "id", "left")
    counted = j.withColumn("consolidated_count", F.col("consolidated_count") + F.coalesce("more", F.lit(0)).cast("int")).withColumn("is_active", F.col("is_active") & ~F.coalesce("out", F.lit(False)) & F.col("merged_away").isNull()).drop("more", "out", "merged_away")
    texts = verdicts.where("verdict = 'EVOLUTION'").select(F.col("old_id").alias("id"), F.col("merged").alias("new_fact"), F.lit("evolution").alias("reason"), F.col("new_id").alias("place"))
    return rewritten(counted, texts, now)


def extracted(batches: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame], schema: str, group: str = "session_id", least: float = 0.7, most: int = 20) -> DataFrame:
    """Facts that an injected extractor finds, gated by confidence, each text once per group in its comparable form, at most ``most`` a group.

    The extractor gets a pandas frame of exchanges and returns one with the columns of ``schema`` (``group``, fact, confidence, ...).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield extractor(p)

    raw = batches.mapInPandas(run, schema).where("confidence is not null and not isnan(confidence)").where(F.col("confidence") >= least)
    keyed = raw.withColumn("_key", comparable("fact"))
    once = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_key").orderBy(F.desc("confidence"), "fact"))).where("_rn = 1")
    return once.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("confidence"), "fact"))).where(F.col("_rn") <= most).drop("_rn", "_key")


def judged(pairs: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Verdicts of an injected judge over pairs, batch by batch where they lie."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield judge(p)

    return pairs.mapInPandas(run, schema)


def unchanged_pairs(log: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs whose last decision saw both facts as they are now: text, scope count and all compare null-safely."""
    last = log.groupBy("relation_id").agg(F.max_by(F.struct("source_fact_id", "target_fact_id", "source_fact", "target_fact", "action"), "id").alias("r")).select("relation_id", "r.*")
    a = facts.select(F.col("id").alias("source_fact_id"), F.col("fact").alias("source_now"))
    b = facts.select(F.col("id").alias("target_fact_id"), F.col("fact").alias("target_now"))
    return last.join(a, "source_fact_id").join(b, "target_fact_id").where(F.col("source_fact").eqNullSafe(F.col("source_now")) & F.col("target_fact").eqNullSafe(F.col("target_now"))).select("relation_id", "source_fact_id", "target_fact_id", "action")


def valid_findings(findings: DataFrame, size: int, slugs: list[str], least: float) -> DataFrame:
    """Findings of a judge that refer to an item of its batch and a known slug and are sure enough; an index claimed twice is dropped."""
    ok = findings.where((F.col("item_index") >= 0) & (F.col("item_index") < size) & F.col("slug").isin(slugs) & (F.col("confidence") >= least) & (F.col("confidence") <= 1))
    n = F.count("*").over(Window.partitionBy("batch", "item_index", "slug"))
    return ok.withColumn("_n", n).where("_n = 1").drop("_n")


def summarised(turns: DataFrame, summarise: Callable[[list[str]], str], ws: Workspace, group: str = "session_id", place: str = "place", text: str = "text", direct: int = 15, chunk: int = 8) -> DataFrame:
    """(group, summary) by an injected summariser: short conversations directly, long ones by chunks and then over their summaries.

    ``place`` numbers the turns of a group from 0. A task sees one chunk at a time, and then the summaries of one group; where these
    are too many they are summarised in chunks again, so no call gets more than ``direct`` texts. Every level is written, so no text
    is summarised twice.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(place)
        return pd.DataFrame({group: [p[group].iloc[0]], place: [int(p[place].iloc[0])], text: [summarise([t or "" for t in p[text]])], "_last": [bool(p["_last"].iloc[0])]})

    schema = f"`{group}` {turns.schema[group].dataType.simpleString()}, `{place}` int, `{text}` string, `_last` boolean"
    level = turns.select(group, F.col(place).cast("int").alias(place), text)
    out = None
    while True:
        sizes = level.groupBy(group).agg((F.max(place) + 1).alias("_n"))
        last = F.col("_n") <= direct
        part = F.when(last, F.lit(0)).otherwise(F.floor(F.col(place) / chunk)).cast("int")
        sized = skew_safe_lookup(level, sizes, group, "inner").select(group, part.alias("_part"), place, text, last.alias("_last"))
        done = ws.save(sized.groupBy(group, "_part").applyInPandas(run, schema), "summaries", left=F.count_if(~F.col("_last")))
        ended = done.where("_last").select(group, F.col(text).alias("summary"))
        out = ended if out is None else out.unionByName(ended)
        if not done.seen["left"]:
            return out
        # chunks are numbered by their first turn: the next level numbers them from 0 again
        level = done.where("not _last").select(group, F.floor(F.col(place) / chunk).cast("int").alias(place), text)


def conversation_texts(turns: DataFrame, group: str) -> DataFrame:
    """(group, batch, text): the exchanges of each batch (batch, place, user_message, assistant_message) as one text, in order."""
    said = F.concat(F.lit("User: "), F.coalesce("user_message", F.lit("")), F.lit("\n\nAgent: "), F.coalesce("assistant_message", F.lit("")))
    held = turns.select(group, "batch", F.struct("place", said.alias("said")).alias("t")).groupBy(group, "batch").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select(group, "batch", F.array_join(F.transform("t", lambda x: x["said"]), "\n\n---\n\n").alias("text"))
