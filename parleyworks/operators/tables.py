"""Operators on whole tables: upserts, deletes, first-wins merges, ranking, pages, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace, skew_safe_lookup
from .hierarchy import prefix_sums


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``. Map-side: the limit runs before the shuffle (window group limit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` instead of those with the same key. A second run changes nothing."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def delete_with_children(parents: DataFrame, children: list[tuple[DataFrame, str]], gone: DataFrame, key: str = "id") -> list[DataFrame]:
    """Parents and children without the rows that belong to the keys of ``gone``. children: (table, foreign key)."""
    out = [parents.join(gone.select(key), key, "left_anti")]
    for child, fk in children:
        out.append(child.join(gone.select(F.col(key).alias(fk)), fk, "left_anti"))
    return out


def first_wins(parts: list[DataFrame], key: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Results of several passes as one: a key counts by the first pass that has it; in order of pass, then ``order``."""
    all_parts = None
    for k, p in enumerate(parts):
        p = p.withColumn("pass_no", F.lit(k))
        all_parts = p if all_parts is None else all_parts.unionByName(p, allowMissingColumns=True)
    kept = latest(all_parts, key, [F.col("pass_no"), *[F.col(c) for c in order]])
    return kept.orderBy("pass_no", *order).limit(limit) if limit is not None else kept


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= n)


def keyset_page(df: DataFrame, columns: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows in order of ``columns`` after the given position; without a position the first."""
    if after is not None:
        cond = F.lit(False)
        for k, (c, v) in enumerate(zip(columns, after)):
            same = F.lit(True)
            for p, w in zip(columns[:k], after[:k]):
                same = same & (F.col(p) == F.lit(w))
            cond = cond | (same & (F.col(c) > F.lit(v)))
        df = df.where(cond)
    return df.orderBy(*columns).limit(size)


def offset_page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page with the count of all rows beside each."""
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(df.count()).cast("bigint"))


def numbered(ws: Workspace, df: DataFrame, group: list[str], order: list[str], out: str = "number") -> DataFrame:
    """Add a running number from 0 within each group, in order of ``order`` (a total order with the group, no null groups).

    It is a running sum over range partitions, so a group of very many rows is spread over tasks.
    """
    run = prefix_sums(ws, df.withColumn("_one", F.lit(1)), [*group, *order], "_one", "_run").drop("_one")
    key = F.to_json(F.struct(*group))
    first = run.groupBy(key.alias("_group")).agg(F.min("_run").alias("_first"))
    return skew_safe_lookup(run.withColumn("_group", key), first, "_group", "inner").withColumn(out, F.col("_run") - F.col("_first")).drop("_run", "_first", "_group")


def batched(ws: Workspace, df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Add ``batch`` (from 0) and ``place`` in it: rows of a group in order, ``size`` a batch."""
    n = numbered(ws, df, group, order, "_no")
    return n.withColumn("batch", F.floor(F.col("_no") / size).cast("int")).withColumn("place", (F.col("_no") % size).cast("int")).drop("_no")


def spread(df: DataFrame, group: list[str], index: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly over ``index`` (0, 1, ...), first and last among them."""
    key = F.to_json(F.struct(*group))
    size = df.groupBy(key.alias("_group")).agg((F.max(index) + 1).alias("_n"))
    step = (F.col("_n") - 1) / F.lit(max(1, most - 1))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * step + 0.5).cast("int"))
    sized = skew_safe_lookup(df.withColumn("_group", key), size, "_group", "inner")
    return sized.where((F.col("_n") <= most) | F.array_contains(chosen, F.col(index).cast("int"))).drop("_n", "_group")


def set_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with ``side`` left or right."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def reconciled(files: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """State of each file against the index: files (path, modified), index (path, indexed). missing, orphaned, outdated or ok."""
    state = (
        F.when(F.col("indexed").isNull(), "missing").when(F.col("modified").isNull(), "orphaned").when(F.col("modified") > F.col("indexed"), "outdated").otherwise("ok")
    )
    return files.join(index, key, "full_outer").select(key, state.alias("state"))


def budgeted(df: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The rows of each group, in order, as long as their sizes (1 at least) add up to the budget; the first always stays.

    No more than budget + 1 rows of a group can stay, so the limit runs before the shuffle.
    """
    df = top_per_group(df, group, order, budget + 1, "_place").drop("_place")
    size = F.greatest(size, F.lit(1))
    w = Window.partitionBy(*group).orderBy(*order)
    used = df.withColumn("_no", F.row_number().over(w)).withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.max(((F.col("_sum") > budget) & (F.col("_no") > 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return used.withColumn("_over", over).where("_over = 0").withColumnRenamed("_sum", "used").drop("_no", "_over")


def with_quota(df: DataFrame, group: list[str], first: Column, order: list[Column], limit: int) -> DataFrame:
    """``limit`` rows a group: the best ceil(limit / 2) of those that ``first`` holds for are sure, the best others fill up."""
    sure = -(-limit // 2)
    w = Window.partitionBy(*group, F.coalesce(first, F.lit(False))).orderBy(*order)
    marked = df.withColumn("_sure", F.coalesce(first, F.lit(False)) & (F.row_number().over(w) <= sure))
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_sure"), *order))).where(F.col("rank") <= limit).drop("_sure")


def filled_forward(ws: Workspace, df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """``columns`` with each null replaced by the last value before it in its group, by ``order`` (unique in a group).

    Rows are range-partitioned by group and order, so a long group is spread over many tasks; only the last values of each group in each
    partition are brought together.
    """
    ranged = ws.save(df.repartitionByRange(group, order).withColumn("_pid", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("_pid", group).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    come = ends.select("_pid", group, *[F.last(c, ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns])
    inside = Window.partitionBy("_pid", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(come, ["_pid", group])
    kept = [c for c in df.columns if c not in columns]
    return joined.select(*kept, *[F.coalesce(F.last(c, ignorenulls=True).over(inside), f"_in_{c}").alias(c) for c in columns])
