"""Archives and versioned tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the most bytes that an archive may unpack to as one text; a smaller cap can be passed, not a larger one.
CAP = 256 * 1024 * 1024


def archives(spark: SparkSession, path: str, cap: int = CAP) -> DataFrame:
    """(file, text) of plain and zstd-compressed transcripts; of two variants of a file the newer one. A file that unpacks to more
    than the cap, or isn't valid, has a null text; ``archive_lines`` reads files of any size."""
    cap = min(cap, CAP)
    newest = _newest(spark, path)

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        def text(path: str, content: bytes) -> str | None:
            try:
                if path.endswith(".zst"):
                    with zstandard.ZstdDecompressor().stream_reader(content) as r:
                        content = r.read(cap + 1)
                return content.decode("utf-8", "replace") if len(content) <= cap else None
            except zstandard.ZstdError:
                return None

        for p in parts:
            yield pd.DataFrame({"file": p["file"], "text": [text(a, bytes(b)) for a, b in zip(p["path"], p["content"])]})

    return newest.mapInPandas(unpack, "file string, text string")


def _newest(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, content): of two variants of a file the newer one. Variants are ranked by name and time alone; contents aren't shuffled
    as long as the list of names is small enough to be sent around, which Spark decides."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").load(path)
    named = raw.withColumn("file", F.regexp_replace("path", r"\.zst$", "")).where(F.col("file").endswith(".jsonl"))
    best = named.groupBy("file").agg(F.max_by("path", F.struct("modificationTime", F.col("path").endswith(".zst").cast("int") * -1)).alias("path"))
    return raw.select("path", "content").join(best, "path")


def archive_lines(spark: SparkSession, path: str, per_frame: int = 10_000) -> DataFrame:
    """(file, line, text): the lines, from 1, of plain and zstd-compressed transcripts, unpacked as a stream, so files may unpack to any
    size. Of two variants the newer one counts; of a file that isn't valid the lines before the fault. Blank lines are left out."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import zstandard

        for p in parts:
            for file, at, content in zip(p["file"], p["path"], p["content"]):
                stream = io.BytesIO(bytes(content))
                if at.endswith(".zst"):
                    stream = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
                held: list[tuple[int, str]] = []
                reader = io.TextIOWrapper(io.BufferedReader(stream), "utf-8", "replace", newline="\n")
                n = 0
                while True:
                    try:
                        text = reader.readline()
                    except zstandard.ZstdError:
                        break
                    if not text:
                        break
                    n += 1
                    if text.strip():
                        held.append((n, text.rstrip("\r\n")))
                    if len(held) >= per_frame:
                        yield pd.DataFrame({"file": file, "line": [k for k, _ in held], "text": [t for _, t in held]})
                        held = []
                if held:
                    yield pd.DataFrame({"file": file, "line": [k for k, _ in held], "text": [t for _, t in held]})

    return _newest(spark, path).mapInPandas(unpack, "file string, line int, text string")


def newer_files(spark: SparkSession, path: str, manifest: DataFrame, glob: str = "*.jsonl*") -> DataFrame:
    """(file, modified) of files that the manifest (file, modified) lacks or has older."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select(plain_path("path").alias("file"), F.col("modificationTime").alias("modified"))
    seen = manifest.groupBy("file").agg(F.max("modified").alias("was"))
    return now.join(seen, "file", "left").where("was is null or modified > was").select("file", "modified")


def plain_path(c: Column | str) -> Column:
    """A file's address in one spelling: sources differ in the slashes after ``file:``."""
    return F.regexp_replace(c, "^file:/+", "file:/")


#: Buckets of a table that is changed in place of rows, and the columns of a version that lists them.
BUCKETS = 256
_PARTS = ["_bucket", "_path"]


class Store:
    """Tables as immutable versions ``name/v=N``. The current one is the highest that is complete, which the mark that Spark writes last
    tells, so a reader sees whole versions only, at any moment."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self, name: str, complete: bool) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("v=")]
        return [int(x.getName()[2:]) for x in found if not complete or fs.exists(mark(x, "_SUCCESS"))]

    def version(self, name: str) -> int:
        """The current version, 0 where there is none."""
        return max(self._numbers(name, True), default=0)

    def read(self, name: str) -> DataFrame:
        n = self.version(name)
        if not n:
            raise FileNotFoundError(f"no version of {name} in {self.root}")
        found = self.spark.read.parquet(f"{self.root}/{name}/v={n}")
        if found.columns != _PARTS:
            return found
        return self._parts([r["_path"] for r in found.orderBy("_bucket").collect()])  # no more than there are buckets

    def _parts(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths)

    def upsert(self, name: str, new: DataFrame, key: list[str], by: list[str] | None = None, buckets: int = BUCKETS) -> int:
        """A version in which the rows of ``new`` stand instead of those with the same key.

        The table lies in buckets by the hash of ``by`` (the key by default; rows of one key must have one ``by``), and a version lists where each
        bucket lies, so only the buckets that ``new`` has rows for are read and written again. Without rows nothing changes.
        """
        n = self.version(name)
        bucketed = new.withColumn("_bucket", F.pmod(F.xxhash64(*(by or key)), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in bucketed.select("_bucket").distinct().collect()]
        if not touched and n:
            return n
        held = {r["_bucket"]: r["_path"] for r in self.spark.read.parquet(f"{self.root}/{name}/v={n}").collect()} if n else {}
        again = [held[b] for b in touched if b in held]
        if again:
            old = self._parts(again)
            old = old.join(bucketed.select(*key).distinct(), key, "left_anti")
            bucketed = old.withColumn("_bucket", F.pmod(F.xxhash64(*(by or key)), F.lit(buckets)).cast("int")).unionByName(bucketed, allowMissingColumns=True)
        at = f"{self.root}/{name}/data-{uuid.uuid4().hex}"
        bucketed.repartition("_bucket").write.partitionBy("_bucket").parquet(at)
        if not touched:
            bucketed.limit(0).drop("_bucket").write.parquet(f"{at}/_bucket=-1")
        held |= {b: f"{at}/_bucket={b}" for b in touched or [-1]}
        return self.publish(name, self.spark.createDataFrame(sorted(held.items()), "_bucket int, _path string").coalesce(1))

    def publish(self, name: str, df: DataFrame) -> int:
        """Write the next version, whose number no other one has, a broken one neither."""
        n = max(self._numbers(name, False), default=0) + 1
        df.write.mode("error").parquet(f"{self.root}/{name}/v={n}")
        return n


def confined(path: str, roots: list[str], endings: tuple[str, ...] = (".jsonl", ".jsonl.zst")) -> str:
    """The real path of a file that may be read: under one of the roots once links are followed, and of a known kind; else ValueError."""
    import os

    real = os.path.realpath(path)
    inside = any(real == (r := os.path.realpath(root)) or real.startswith(r.rstrip("/") + "/") for root in roots)
    if not inside or not real.endswith(endings):
        raise ValueError(f"{path} may not be read")
    return real
