"""Streams: incremental ingestion of transcripts, repeats, session ledgers, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import top_per_group
from ..session import Workspace
from ..sources import transcripts
from ..sources.files import Store, newer_files


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream that ends with what is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return r.parquet(path)
    folder, _, name = path.rpartition("/")
    return r.option("pathGlobFilter", name).parquet(folder)


def run_to_end(df: DataFrame, sink: str, progress: str, mode: str = "append") -> None:
    """Process what is there, once, into a Parquet folder; a restart goes on from the progress folder."""
    df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def upsert_each_batch(stream: DataFrame, store: Store, name: str, progress: str, change: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Publish a new version of a table per micro-batch: ``change(current or None, batch)``. A batch that is run again gives the same."""

    def apply(batch: DataFrame, _: int) -> None:
        current = store.read(name) if store.version(name) else None
        store.publish(name, change(current, batch))

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(stream: DataFrame, store: Store, name: str, key: list[str], progress: str, by: list[str] | None = None) -> None:
    """Bring each micro-batch into a bucketed table; only the buckets that it has rows for are written. Of rows with one key any of a
    batch may stay. A batch that is run again changes nothing."""
    stream.writeStream.foreachBatch(lambda batch, _: store.upsert(name, batch.dropDuplicates(key), key, by)).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def without_repeats(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Rows once per key within the watermark's delay.

    A stream's watermark begins at 1970, and what lies before it is dropped as late; so null and earlier times count as that.
    """
    begin = F.lit("1970-01-01 00:00:01").cast("timestamp")
    marked = stream.withColumn("_time", F.greatest(F.coalesce(F.col(time).cast("timestamp"), begin), begin)).withWatermark("_time", delay)
    return marked.dropDuplicatesWithinWatermark(key).drop("_time")


def windowed_counts(events: DataFrame, time: str, width: str, slide: str | None, group: list[str], delay: str = "1 hour") -> DataFrame:
    """(start, group, n, total): events by tumbling or sliding window; the same plan on a stream and on a table."""
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(w.alias("w"), *group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *group, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, user: str, delay: str = "1 hour") -> DataFrame:
    """(user, start, n): runs of events of a user without a gap of that length."""
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    return events.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), "n")


def ledger(shown: DataFrame, now, most: int = 400, days: int = 7) -> DataFrame:
    """(session_id, ids): what a session was shown lately, the last ``most`` ids, none older than ``days``. shown: session_id, id, at."""
    fresh = shown.where(F.col("at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    last = fresh.groupBy("session_id", "id").agg(F.max("at").alias("at"))
    last = top_per_group(last, ["session_id"], [F.desc("at"), F.desc("id")], most)
    ranked = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("l"))
    return ranked.select("session_id", F.transform("l", lambda x: x["id"]).alias("ids"))


def ingest_transcripts(spark: SparkSession, path: str, store: Store, ws: Workspace, excluded: list[str] | None = None, markers: list[str] | None = None, glob: str = "*.jsonl") -> dict[str, int]:
    """Bring new and changed transcripts of either dialect into the store's ``exchanges``; returns how many files and exchanges came.

    What is new is told by the manifest of files read before; a file that holds an exclusion marker or names an excluded folder is
    noted and left out. Exchanges replace those with the same id, so a second run changes nothing.
    """
    manifest = store.read("files") if store.version("files") else spark.createDataFrame([], "file string, modified timestamp")
    fresh = ws.save(newer_files(spark, path, manifest, glob), "fresh")
    count = fresh.count()
    if not count:
        return {"files": 0, "exchanges": 0}
    raw = transcripts.lines(spark, path, ws, glob).join(fresh.select("file"), "file", "left_semi")
    if markers:
        raw = raw.join(transcripts.excluded_files(raw, markers), "file", "left_anti")
    if excluded:
        raw = raw.join(transcripts.file_projects(raw, excluded).where("excluded").select("file"), "file", "left_anti")
    raw = ws.save(raw.join(transcripts.dialects(raw), "file"), "raw")
    parts = []
    for kind, read in (("A", transcripts.messages_a), ("B", lambda own: transcripts.messages_b(own, ws))):
        own = raw.where(F.col("dialect") == kind).drop("dialect")
        if own.limit(1).count():
            parts.append(transcripts.indexed(transcripts.exchanges(read(own), ws)).withColumn("tools", F.to_json("tools")))
    new = None
    for p in parts:
        new = p if new is None else new.unionByName(p)
    found = 0
    if new is not None:
        new = ws.save(new, "new")
        found = new.count()
        # by file: what comes of a few files changes few buckets
        store.upsert("exchanges", new, ["id"], by=["archive_path"])
    store.upsert("files", fresh, ["file"])
    return {"files": count, "exchanges": found}
