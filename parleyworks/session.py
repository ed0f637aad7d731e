"""Session helpers: table access, shared workspaces for written intermediate tables, skew-safe lookups."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than this share of the rows, and at least HOT_ROWS rows, is treated apart in lookups.
HOT_SHARE = 1 / 500
HOT_ROWS = 50_000

_live: list["Workspace"] = []


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever they run and whatever their search path is; once per context.

    Functions are sent to workers by the name of their module, so the module must be there. The driver's file server hands the archive
    out, so executors need no folder in common with the driver for it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_parleyworks_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="parleyworks-code-"), "parleyworks.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(at)
    sc._parleyworks_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one where that is unset and all runs on this machine.

    On a cluster a folder of one machine would lose steps, so there the setting must be made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="parleyworks-"))
    return spark.sparkContext.getCheckpointDir()


class Workspace:
    """A folder of written tables under the shared root.

    Iterative operators cut their lineage by writing a step and reading it back, so a lost executor costs a re-read of
    the last step only. ``drop`` removes steps that are superseded; what is left goes at exit.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_root(spark).rstrip('/')}/parleyworks/{label}-{uuid.uuid4().hex}"
        self.steps = 0
        _live.append(self)

    def child(self, name: str) -> str:
        self.steps += 1
        return f"{self.path}/{self.steps:04d}-{name}"

    def save(self, df: DataFrame, name: str, **figures: Column) -> DataFrame:
        """Write ``df`` and return it as read back, with its path as attribute ``saved_at`` and, as attribute ``seen``, the number of its
        ``rows`` and the aggregates ``figures``, which are taken while it is written."""
        at = self.child(name)
        watch = Observation()
        df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()]).write.parquet(at)
        back = self.spark.read.schema(df.schema).parquet(at)
        back.saved_at, back.seen = at, watch.get
        return back

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            at = getattr(df, "saved_at", None)
            if at:
                self._delete(at)

    def holds(self, df: DataFrame) -> bool:
        """Whether a saved step is still there."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{df.saved_at}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _delete(self, at: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the session may be gone by then
            pass


@atexit.register
def _clean() -> None:
    for ws in _live:
        if ws.spark.sparkContext._jsc is not None:
            ws.close()


def state_of(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table's files from another: how many files and bytes, and the latest change."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.getContentSummary(at)
    status = fs.getFileStatus(at)
    times = [f.getModificationTime() for f in fs.listStatus(at)] if status.isDirectory() else []
    return (spark.sparkContext.applicationId, path, held.getFileCount(), held.getLength(), max([status.getModificationTime(), *times]))


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS, rows: int | None = None) -> list:
    """Keys that hold more than ``share`` of the rows and at least ``least``: at most ``1 / share`` values.

    ``rows`` is how many rows there are at most, where that is known; else they are counted. Few rows need no count by key. Counts by key
    are combined on the map side, and no more keys than ``1 / share`` can come to the driver.
    """
    total = df.count() if rows is None else rows
    if total < least:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    return [r[0] for r in counts.where(F.col("count") >= max(least, int(total * share))).collect()]


def skew_safe_lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left", share: float = HOT_SHARE, least: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Join ``big`` with ``small`` (one row per ``key``) where a few keys may hold most rows of ``big``.

    The rows of hot keys meet their partner by a broadcast of the hot part of ``small``, which has at most ``1 / share``
    rows; all others by an ordinary join. Rows with a null key are kept for ``left`` and dropped for ``inner``. ``rows`` is a bound
    of the number of rows of ``big``, where one is known.
    """
    hot = hot_keys(big, key, share, least, rows)
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(small.where(F.col(key).isin(hot)))
    return big.where(is_hot).join(few, key, how).unionByName(big.where(~is_hot).join(small.where(~F.col(key).isin(hot)), key, how))
