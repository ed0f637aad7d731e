"""Reports over exchanges, tool calls, facts and the log of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_main_conversation, path_slug
from ..session import Workspace, skew_safe_lookup
from .hierarchy import prefix_sums

# Tools that say nothing of what is being done.
GENERIC_TOOLS = ["Read", "Write", "Edit", "Bash", "Glob", "Grep", "LS", "TodoWrite", "Task", "WebFetch", "WebSearch", "MultiEdit"]
GENERIC_STEPS = ["Read", "Write", "Edit", "Bash", "Glob", "Grep"]


def coverage(exchanges: DataFrame) -> DataFrame:
    """One row: distinct conversations, sessions and projects, exchanges, first and last time."""
    return exchanges.agg(
        F.countDistinct("archive_path").alias("conversations"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("project").alias("projects"),
        F.count("*").alias("exchanges"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    )


def project_rollup(exchanges: DataFrame) -> DataFrame:
    return exchanges.groupBy("project").agg(F.countDistinct("archive_path").alias("conversations"), F.countDistinct("session_id").alias("sessions"), F.count("*").alias("exchanges"), F.max("timestamp").alias("last_at"))


def facts_per_slug(facts: DataFrame) -> DataFrame:
    """Active facts of a project by its slug, whether its scope is stored as slug or path."""
    return facts.where("is_active and scope_project is not null").groupBy(path_slug("scope_project").alias("project")).agg(F.count("*").alias("facts"))


def project_report(exchanges: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """The ``n`` projects with most exchanges, with their facts (0 where none)."""
    top = project_rollup(exchanges).orderBy(F.desc("exchanges"), "project").limit(n)
    return top.join(facts_per_slug(facts), "project", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))


def monthly(exchanges: DataFrame, months: int) -> DataFrame:
    """Exchanges of the newest ``months`` months that have any."""
    return exchanges.groupBy(F.substring("timestamp", 1, 7).alias("month")).agg(F.count("*").alias("exchanges"), F.countDistinct("session_id").alias("sessions")).where("month is not null").orderBy(F.desc("month")).limit(months)


def main_conversations(exchanges: DataFrame) -> DataFrame:
    paths = exchanges.select("archive_path").distinct().where("archive_path is not null")
    return paths.agg(F.count_if(is_main_conversation("archive_path")).alias("main"), F.count_if(~is_main_conversation("archive_path")).alias("other"))


def fact_counts(facts: DataFrame) -> DataFrame:
    """(kind, value, n): facts by state, and the active ones by category and scope, in one pass."""
    kinds = F.array(
        F.struct(F.lit("state").alias("kind"), F.when(F.col("is_active"), "active").otherwise("inactive").alias("value")),
        F.when(F.col("is_active"), F.struct(F.lit("category").alias("kind"), F.coalesce("category", F.lit("uncategorized")).alias("value"))),
        F.when(F.col("is_active"), F.struct(F.lit("scope").alias("kind"), F.coalesce("scope_type", F.lit("none")).alias("value"))),
    )
    return facts.select(F.explode(F.array_compact(kinds)).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def domain_counts(facts: DataFrame, categories: DataFrame) -> DataFrame:
    """Active facts by domain."""
    return facts.where("is_active").join(categories, "category_id").groupBy("domain_id").agg(F.count("*").alias("facts"), F.countDistinct("category_id").alias("categories"))


def ontology_summary(facts: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category with its active facts, 0 where none: facts are counted before the join."""
    counts = facts.where("is_active and category_id is not null").groupBy("category_id").agg(F.count("*").alias("facts"))
    return categories.join(counts, "category_id", "left").select("domain_id", "category_id", F.coalesce("facts", F.lit(0)).alias("facts"))


def tool_frequency(calls: DataFrame, n: int, generic: list[str] | None = None) -> DataFrame:
    generic = GENERIC_TOOLS if generic is None else generic
    return calls.where(F.col("tool_name").isNotNull() & ~F.col("tool_name").isin(generic)).groupBy("tool_name").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool_name").limit(n)


def tool_sequences(calls: DataFrame, ws: Workspace, least: int, n: int, generic: list[str] | None = None) -> DataFrame:
    """Pairs of tools where one was called before the other in the same exchange, at least ``least`` times.

    Calls are counted per exchange, time and tool. For every tool of an exchange a running sum over its times, taken over range
    partitions, tells how many of its calls came before each call of the others; so neither pairs of calls nor all calls of an
    exchange come together anywhere.
    """
    generic = GENERIC_STEPS if generic is None else generic
    used = calls.where(F.col("tool_name").isNotNull() & ~F.col("tool_name").isin(generic) & F.col("timestamp").isNotNull() & F.col("exchange_id").isNotNull())
    at = used.groupBy("exchange_id", "timestamp", "tool_name").agg(F.count("*").alias("n"))
    tools = at.groupBy("exchange_id").agg(F.collect_set("tool_name").alias("tools"))
    each = skew_safe_lookup(at, tools, "exchange_id", "inner").select("exchange_id", "timestamp", F.col("tool_name").alias("next_tool"), "n", F.explode("tools").alias("tool_name"))
    # at one time the tool's own row comes last: calls at the same time are not before each other
    own = (F.col("tool_name") == F.col("next_tool")).cast("int")
    rows = each.withColumn("own", own).withColumn("counted", F.col("own") * F.col("n")).withColumn("series", F.xxhash64("exchange_id", "tool_name"))
    run = prefix_sums(ws, rows, ["series", "exchange_id", "tool_name", "timestamp", "own", "next_tool"], "counted", "run")
    first = run.groupBy("exchange_id", "tool_name", "series").agg(F.min("run").alias("first"))
    key = F.concat_ws("|", "exchange_id", "tool_name")
    before = skew_safe_lookup(run.withColumn("key", key), first.select(key.alias("key"), "first"), "key", "inner")
    pairs = before.groupBy("tool_name", "next_tool").agg(F.sum(F.col("n") * (F.col("run") - F.col("first"))).alias("n"))
    return pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "tool_name", "next_tool").limit(n)


def project_connections(exchanges: DataFrame, more_than: int) -> DataFrame:
    """Pairs of projects that share sessions: sum over sessions of the product of their exchange counts.

    Counts per (session, project) come first, so the join is of projects of a session, not of its exchanges.
    """
    per = exchanges.where("session_id is not null and project is not null").groupBy("session_id", "project").agg(F.count("*").alias("n"))
    other = per.select("session_id", F.col("project").alias("other"), F.col("n").alias("m"))
    return per.join(other, "session_id").where("project < other").groupBy("project", "other").agg(F.sum(F.col("n") * F.col("m")).alias("links")).where(F.col("links") > more_than)


def project_profile(exchanges: DataFrame, project: str, now: str) -> DataFrame:
    """One row on a project; ``now`` is a date, so the result doesn't depend on the day of the run."""
    first = F.to_date(F.substring(F.min("timestamp"), 1, 10))
    return exchanges.where(F.col("project") == project).agg(
        F.count("*").alias("exchanges"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("git_branch").alias("branches"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
        F.datediff(F.lit(now).cast("date"), first).alias("days"),
    )


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the smaller one. Counts are combined before the ranking."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("n"), F.col(value))).alias("b")).select(group, f"b.{value}", "b.n")


def quantiles(df: DataFrame, value: str, points: list[float], ws: Workspace | None = None) -> DataFrame:
    """(point, value): the element at floor(point * n) of the sorted values, without interpolation.

    Distinct values are counted, and the running count finds the elements; no value list is gathered in one place.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    total = v.agg(F.sum("n")).first()[0] or 0
    ranged = v.repartitionByRange("value").withColumn("pid", F.spark_partition_id())
    if ws is not None:
        ranged = ws.save(ranged, "ranged")
    per = ranged.groupBy("pid").agg(F.sum("n").alias("s"))
    before = per.select("pid", (F.sum("s").over(Window.orderBy("pid")) - F.col("s")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    run = ranged.join(F.broadcast(before), "pid").withColumn("upto", F.col("before") + inside).withColumn("total", F.lit(total).cast("bigint"))
    asked = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("point")) for p in points]))
    wanted = run.select("value", "n", "upto", "total", asked.alias("q")).withColumn("at", F.least(F.col("total") - 1, F.floor(F.col("q.point") * F.col("total"))))
    return wanted.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select(F.col("q.point").alias("point"), "value")


def content_duplicates(facts: DataFrame) -> DataFrame:
    """(id, keeper): active facts with the same text and scope, and the one that stays (best confirmed, then oldest, then least id).

    Groups are counted on the map side; a group of very many copies meets its one row by a lookup that stands hot keys.
    """
    key = F.sha2(F.to_json(F.struct(F.coalesce("fact", F.lit("")).alias("f"), F.col("fact").isNull().alias("n"), F.coalesce("scope_type", F.lit("")).alias("t"), F.coalesce("scope_project", F.lit("")).alias("p"))), 256)
    active = facts.where("is_active").select("id", "consolidated_count", "created_at", key.alias("key"))
    groups = active.groupBy("key").agg(F.count("*").alias("copies"), F.min_by("id", F.struct((-F.col("consolidated_count")).alias("c"), "created_at", "id")).alias("keeper")).where("copies > 1")
    return skew_safe_lookup(active, groups, "key", "inner").select("id", "keeper", "copies")


def agreement_by_threshold(pairs: DataFrame, score: str, agrees: str, thresholds: list[float]) -> DataFrame:
    """(threshold, fired, agreement): how often the score reaches each threshold, and how often it is right then; one pass."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    return pairs.select(t, F.col(score).alias("s"), F.col(agrees).alias("a")).groupBy("threshold").agg(
        F.round(F.avg(F.when(F.col("s") >= F.col("threshold"), 1.0).otherwise(0.0)), 6).alias("fired"),
        F.round(F.avg(F.when(F.col("s") >= F.col("threshold"), F.col("a").cast("double"))), 6).alias("agreement"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bootstrap_means(df: DataFrame, group: str, value: str, rounds: int, seed: int) -> DataFrame:
    """(group, low, high): the 2.5 % and 97.5 % points of the mean under Poisson resampling of rows, seeded per row and round.

    Every row meets every round once and is combined on the map side; the means that are sorted are ``rounds`` a group.
    """
    u = (F.pmod(F.xxhash64("r.round", "_id", F.lit(seed)), F.lit(1_000_000)) + 0.5) / 1_000_000
    # the inverse of Poisson(1)'s distribution function
    weight = F.lit(0)
    total = 0.0
    p = 0.36787944117144233
    for k in range(8):
        total += p
        weight = weight + F.when(F.col("u") > total, 1).otherwise(0)
        p /= k + 1
    # rows that are equal are told apart by a number of their own
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    rows = counted.withColumn("_id", F.xxhash64(*[F.col(c).cast("string") for c in df.columns], "_copy")).select(group, value, "_id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    drawn = rows.select(group, value, "round", F.struct("round").alias("r"), "_id").withColumn("u", u).withColumn("w", weight)
    means = drawn.groupBy(group, "round").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.groupBy(group).agg(F.sort_array(F.collect_list("m")).alias("ms")).select(group, F.element_at("ms", int(rounds * 0.025) + 1).alias("low"), F.element_at("ms", int(rounds * 0.975)).alias("high"))


def majority(votes: DataFrame, item: list[str], verdict: str, confidence: str, vote: str, needed: int, upper: bool = True) -> DataFrame:
    """Verdicts that at least ``needed`` votes give an item, with the median confidence (the upper or the lower one of two).

    A vote has one voice for an item and verdict, its first by confidence.
    """
    once = votes.groupBy(*item, verdict, vote).agg(F.max(F.coalesce(confidence, F.lit(0.0))).alias("c"))
    median = F.expr(f"percentile_disc(0.5) within group (order by c{' desc' if upper else ''})")
    return once.groupBy(*item, verdict).agg(F.count("*").alias("votes"), median.alias("confidence")).where(F.col("votes") >= needed)


def recommendations(open_work: dict[str, DataFrame]) -> DataFrame:
    """(what, n): the kinds of open work of which there is any, with how much; no row where all is done."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in open_work.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def markdown_table(df: DataFrame, rows: int = 50) -> str:
    """A small result as a Markdown table."""
    cells = lambda r: "| " + " | ".join(str("" if v is None else v).replace("|", "\\|").replace("\n", " ") for v in r) + " |"
    return "\n".join([cells(df.columns), cells(["---"] * len(df.columns)), *[cells(r) for r in df.limit(rows).collect()]])
