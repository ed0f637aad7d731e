"""Decisions that follow from tables of rules: what to do with a judged pair, who may take a session, what an error message means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The confidence that a change of an edge needs, and that of retiring a fact; the longest text that a judge sees whole.
EDGE_LEAST, RETIRE_LEAST, SEEN_WHOLE = 0.6, 0.9, 2_000
# Fixed values: (relation, verdict, action, new type, whether the edge is turned round or the source is the one that goes).
RULES = [
    ("CONTRADICTS", "RELATED_NOT_CONFLICTING", "retype", "INFLUENCES", False),
    ("CONTRADICTS", "UNRELATED", "delete", None, False),
    ("CONTRADICTS", "SUPERSEDED_BY_SOURCE", "retype", "SUPERSEDES", False),
    ("CONTRADICTS", "SUPERSEDED_BY_TARGET", "retype", "SUPERSEDES", True),
    ("SUPERSEDES", "BOTH_VALID", "retype", "INFLUENCES", False),
    ("SUPERSEDES", "UNRELATED", "delete", None, False),
    ("SUPERSEDES", "TARGET_REDUNDANT", "deactivate", None, False),
    ("SUPERSEDES", "SOURCE_REDUNDANT", "deactivate", None, True),
]
# Actions whose recorded verdict may be applied again.
REPLANNABLE = ["keep", "delete", "retype"]
# States of a session's extraction, and how long a claim holds.
SEED, PERMANENT, CLAIMED, RETRIABLE, LEASE = -1, -2, -3, -4, "30 minutes"
# What an error message says, in this order; numbers of states count first.
NUMBERED = [r"status(?:\s*code)?\s*[:=]?\s*(\d{3})\b", r"\b(?:api|http|request|response|server)\s+(?:error|failure|code)\s*[:=-]?\s*(\d{3})\b"]
DETERMINISTIC = r"too (large|long)|prompt is too long|context length|maximum.*token|max_?tokens|content.*too|invalid[_ ]?request|bad request|unprocessable"
TRANSIENT = (
    r"unauthor|forbidden|invalid.*(api.?key|access.?token|credential)|timeout|etimedout|econnreset|econnrefused|enotfound|epipe|socket hang up|network|fetch failed|stream (disconnect|closed|ended|aborted)"
    r"|premature close|overloaded|temporarily|rate.?limit|too many requests|internal server error|server error|service unavailable|bad gateway|gateway timeout"
)


def planned(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``plan`` (keep, retype, delete, deactivate), ``plan_type`` and ``plan_first``, ``plan_second``: the ends of the new edge, or the
    fact that goes and the one that stays.

    pairs: relation_type, verdict, confidence, and of both ends (prefix s_ and t_) id, fact, scope_type, scope_project, consolidated_count.
    A pair is kept where no rule fits, the confidence is missing or too small, or both ends are one fact; a fact is only retired for one
    of the same scope that is as well confirmed, if neither is longer than the judge could see.
    """
    rules = pairs.sparkSession.createDataFrame(RULES, "relation_type string, verdict string, _action string, _type string, _turned boolean")
    j = pairs.join(F.broadcast(rules), ["relation_type", "verdict"], "left")  # eight rows
    first = {c: F.when(F.col("_turned"), F.col(f"t_{c}")).otherwise(F.col(f"s_{c}")) for c in ("id", "consolidated_count")}
    second = {c: F.when(F.col("_turned"), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")) for c in ("id", "consolidated_count")}
    retires = F.col("_action") == "deactivate"
    sure = F.col("confidence") >= F.when(retires, RETIRE_LEAST).otherwise(EDGE_LEAST)
    same_scope = F.col("s_scope_type").eqNullSafe(F.col("t_scope_type")) & F.col("s_scope_project").eqNullSafe(F.col("t_scope_project"))
    # of a retired pair the second end is the one that goes
    may_retire = (F.greatest(F.length("s_fact"), F.length("t_fact")) <= SEEN_WHOLE) & same_scope & (second["consolidated_count"] <= first["consolidated_count"])
    acts = F.coalesce(F.col("_action").isNotNull() & (F.col("s_id") != F.col("t_id")) & sure & (~retires | may_retire), F.lit(False))
    return j.select(
        *pairs.columns, F.when(acts, F.col("_action")).otherwise("keep").alias("plan"), F.when(acts, F.col("_type")).alias("plan_type"),
        F.when(acts, F.when(retires, second["id"]).otherwise(first["id"])).alias("plan_first"), F.when(acts, F.when(retires, first["id"]).otherwise(second["id"])).alias("plan_second"),
    )


def is_fresh(state: Column, since: Column, now: Column, lease: str = LEASE) -> Column:
    """Whether a claim still holds: a time that is missing or can't be read holds nothing."""
    return (state == CLAIMED) & F.coalesce(F.try_to_timestamp(since) > now - F.expr(f"interval {lease}"), F.lit(False))


def may_claim(state: Column, since: Column, now: Column, worker: bool) -> Column:
    """Whether a session may be taken: by a worker if it waits for another try or its claim has run out; by the session's own end
    whatever its state, unless a claim holds."""
    fresh = is_fresh(state, since, now)
    return ((state == RETRIABLE) | (state == CLAIMED) & ~fresh) if worker else ~fresh


def error_kind(message: Column) -> Column:
    """transient, deterministic or unknown, from a message: by a labelled number, else by what it says, what is the request's own fault first."""
    m = F.lower(message)
    numbers = [F.regexp_extract(m, p, 1) for p in NUMBERED]
    code = reduce(lambda rest, n: F.when(n != "", n.cast("int")).otherwise(rest), reversed(numbers), F.lit(None).cast("int"))
    by_code = F.when(code.isin(401, 403, 404, 429) | (code >= 500), "transient").when(code.isin(400, 413, 422), "deterministic").otherwise("unknown")
    return F.when(code.isNotNull(), by_code).when(m.rlike(DETERMINISTIC), "deterministic").when(m.rlike(TRANSIENT), "transient").otherwise("unknown")


def principle_coverage(facts: DataFrame, queue: DataFrame, principles: int, cursor: tuple[str, str] | None, same_principles: bool) -> DataFrame:
    """One row (state, unchecked, queued): how far active facts are checked against principles.

    ``cursor`` is the (created_at, id) of the last checked fact, null before the first run; ``same_principles`` whether they are those of that run.
    """
    active = facts.where("is_active")
    after = F.lit(True) if cursor is None or not principles or not same_principles else (F.col("created_at") > cursor[0]) | (F.col("created_at") == cursor[0]) & (F.col("id") > cursor[1])
    waiting = active.join(queue.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("queued"))
    counted = active.agg(F.count_if(after).alias("unchecked")).crossJoin(waiting)  # two single rows
    whole = F.lit("no-principles") if not principles else F.lit("unscanned") if cursor is None else F.lit("principles-changed") if not same_principles else F.when(F.col("unchecked") == 0, "complete").otherwise("partial")
    return counted.select(whole.alias("state"), "unchecked", "queued")
