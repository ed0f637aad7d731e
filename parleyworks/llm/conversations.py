"""Rebuilding conversations from message rows with keyed streaming state.

Messages arrive in any order and in many micro-batches. They are buffered in state keyed by a bucket of sessions (many sessions share
a key, so the number of Python calls follows the data and not the number of sessions), kept by RocksDB; an event-time watermark
decides when a session is closed: when nothing of it came for ``gap``. A closed session is validated and its messages come out
numbered along the chain of parents. Long sessions are found as they come, without a look at the table before: a task that reads more
than ``LOCAL_ROWS`` messages of a session sends the further ones on by their own id and tells the session's bucket, and a bucket that
holds more than ``hot_rows`` of one session lets them go. Their messages come out as fragments, with a mark when the session closes,
and are chained by the distributed hierarchy operator.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.ids import BLANKS, norm_id
from ..operators.hierarchy import build_hierarchy
from ..session import Workspace, skew_safe_lookup

#: Messages of a session that a bucket holds, and that a task sends to it in a micro-batch; more go their own way.
HOT_ROWS, LOCAL_ROWS = 20_000, 4_000
#: Bytes of the table's files for each state key.
BYTES_PER_BUCKET = 500_000
#: Files of a micro-batch of a replay.
FILES_PER_BATCH = 64
#: A session closes when the watermark is so many milliseconds past its last message.
GAP_MS = 30 * 60 * 1000
#: Late rows within this delay are buffered: of a live stream, and of a replay (all rows, so that it equals the batch definition).
DELAY, REPLAY_DELAY = "7 days", "36500 days"
#: Pieces of a bucket's buffer before they are put together.
PIECES = 8
# The state store that keeps state on disk.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200"}

_MESSAGE = "session string, uuid string, parent string, role string, blank boolean, ts timestamp, hot boolean, notice boolean"
_OUT = "session string, uuid string, parent string, role string, blank boolean, hot boolean, closed boolean, seq_no int"
_ARROW = pa.schema([("session", pa.string()), ("uuid", pa.string()), ("parent", pa.string()), ("role", pa.string()), ("blank", pa.bool_()), ("notice", pa.bool_()), ("ts_ms", pa.int64())])
_HELD = [f.name for f in _ARROW]
#: Pieces of the buffer, rows in them, and the earliest time at which a session may have to be closed.
_STATE = "pieces array<binary>, held bigint, due bigint"


def messages(rows: DataFrame) -> DataFrame:
    """The message rows of raw transcript rows: ids in normal form, the role, whether the content is blank, the event time.

    A row counts if its type is user or assistant, it has a session, and it is not marked as of a sidechain. Content is blank
    if it is null, blanks, an empty list, or a list of nothing but text blocks without text; a list that cannot be parsed is
    taken as plain text.
    """
    text = F.btrim(F.col("message.content"), F.lit(BLANKS))
    blocks = F.from_json(text, "array<struct<type:string,text:string>>")
    empty_list = F.coalesce(text.rlike(r"^\[\s*\]$"), F.lit(False))
    no_text = F.forall(blocks, lambda b: (b["type"] == "text") & (F.length(F.btrim(F.coalesce(b["text"], F.lit("")), F.lit(BLANKS))) == 0))
    is_list = text.startswith("[") & text.endswith("]")
    blank = F.coalesce(text == "", F.lit(True)) | empty_list | (F.coalesce(is_list, F.lit(False)) & F.coalesce(no_text, F.lit(False)))
    begin = F.lit("2000-01-02").cast("timestamp")
    stamp = F.try_to_timestamp(F.btrim(F.col("timestamp"), F.lit(BLANKS)))
    return rows.where(F.col("type").isin("user", "assistant") & ~F.coalesce(F.col("isSidechain"), F.lit(False))).select(
        norm_id("sessionId").alias("session"),
        norm_id("uuid").alias("uuid"),
        norm_id("parentUuid").alias("parent"),
        norm_id("message.role").alias("role"),
        blank.alias("blank"),
        # a stream's watermark begins at 1970: null and earlier times count as a later one, or the rows would be dropped as late
        F.least(F.greatest(F.coalesce(stamp, begin), begin), F.lit("2099-01-01").cast("timestamp")).alias("ts"),
    ).where("session is not null")


def sound_sessions(m: pd.DataFrame) -> pd.DataFrame:
    """(session, uuid, seq_no) of the sound sessions among whole ones; m has one row per message.

    Vectorised over all sessions: chains are followed one step for all sessions at a time only among sessions that pass
    every check that needs no order, so the number of steps is the longest such conversation.
    """
    nothing = pd.DataFrame({"session": [], "uuid": [], "seq_no": []})
    if m.empty:
        return nothing
    m = m.reset_index(drop=True)
    root = m["parent"].isna()
    bad = m["blank"] | ~m["role"].isin(["user", "assistant"]) | m["uuid"].isna() | (root & (m["role"] != "user"))
    group = m["session"]
    ok = (root.groupby(group).sum() == 1) & ~bad.groupby(group).any()
    # unbranched: no parent twice
    twice = m[~root].duplicated(["session", "parent"])
    ok &= ~twice.reindex(m.index, fill_value=False).groupby(group).any()
    kept = group.map(ok).astype(bool)
    m, root = m[kept], root[kept]
    if m.empty:
        return nothing
    keys = pd.MultiIndex.from_arrays([m["session"], m["uuid"]])
    parent_at = pd.Series(keys.get_indexer(pd.MultiIndex.from_arrays([m["session"], m["parent"]])), index=m.index)
    child_of = pd.Series(-1, index=range(len(m)))
    has = (parent_at >= 0).to_numpy() & ~root.to_numpy()
    at = pd.Series(range(len(m)))
    child = child_of.to_numpy().copy()
    child[parent_at.to_numpy()[has]] = at.to_numpy()[has]
    role = (m["role"] == "user").to_numpy()
    session = pd.factorize(m["session"])[0]
    n = len(m)
    seq = pd.Series(0, index=range(n)).to_numpy().copy()
    here = at.to_numpy()[root.to_numpy()]
    step = 1
    unanswered = set()
    while len(here):
        seq[here] = step
        nxt = child[here]
        wrong = role[here] & ((nxt < 0) | role[nxt])
        unanswered.update(session[here[wrong]].tolist())
        here, step = nxt[nxt >= 0], step + 1
    frame = pd.DataFrame({"session": m["session"].to_numpy(), "uuid": m["uuid"].to_numpy(), "seq_no": seq, "code": session})
    cut = frame.groupby("code")["seq_no"].min() > 0  # a message that the chain misses keeps 0
    keep = frame["code"].map(cut) & ~frame["code"].isin(unanswered)
    return frame[keep][["session", "uuid", "seq_no"]]


def one_per_message(m: pd.DataFrame) -> pd.DataFrame:
    """One row per session and uuid. Deliveries that differ count by the least parent and role, and as blank if one is; so their order
    says nothing. Messages without a uuid all stay."""
    again = m["uuid"].notna() & m.duplicated(["session", "uuid"], keep=False)
    if not again.any():
        return m
    same = m[again]
    ordered = same.sort_values(["session", "uuid"], kind="stable")
    keys = [ordered["session"], ordered["uuid"]]
    merged = ordered.groupby(["session", "uuid"], sort=False, as_index=False).agg({c: "first" for c in m.columns if c not in ("session", "uuid")})
    for c in ("parent", "role"):
        least = ordered[c].where(ordered[c].notna(), "\U0010ffff").groupby(keys, sort=False).min().to_numpy()
        merged[c] = [None if v == "\U0010ffff" else v for v in least]
    merged["blank"] = ordered["blank"].astype(bool).groupby(keys, sort=False).max().to_numpy()
    merged["ts_ms"] = ordered["ts_ms"].groupby(keys, sort=False).max().to_numpy()
    return pd.concat([m[~again], merged[list(m.columns)]], ignore_index=True)


def _pack(m: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(pa.Table.from_pandas(m[_HELD], _ARROW, preserve_index=False))
    return out.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _row(m: pd.DataFrame, hot: bool, closed: bool = False, seq_no: object = 0) -> pd.DataFrame:
    blank = m["blank"].astype(bool).to_numpy() if "blank" in m else False
    return pd.DataFrame({
        "session": m["session"].to_numpy(), "uuid": m["uuid"].to_numpy() if "uuid" in m else None, "parent": m["parent"].to_numpy() if "parent" in m else None,
        "role": m["role"].to_numpy() if "role" in m else None, "blank": blank, "hot": hot, "closed": closed, "seq_no": pd.Series(seq_no, index=range(len(m)), dtype="int32").to_numpy(),
    })


def _spread(parts: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Mark the messages of sessions of which a task has sent more than ``most``: hot ones go their own way. The session's bucket gets a
    notice instead, with the time of the latest."""
    sent: Counter = Counter()
    for p in parts:
        sent.update(p["session"].value_counts().to_dict())
        long = {s for s in p["session"].unique() if sent[s] > most}
        p = p.assign(hot=p["session"].isin(long), notice=False)
        yield p
        if long:
            last = p[p["hot"]].groupby("session", as_index=False)["ts"].max()
            yield last.assign(uuid=None, parent=None, role=None, blank=False, hot=False, notice=True)[list(p.columns)]


def _fold(gap_ms: int, hot_rows: int):
    """Buffer, close and validate the sessions of a bucket."""

    def let_go(m: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        """Take out the messages of sessions that are too long or were told to be; a notice stays for each."""
        long = m["session"].isin(m.loc[m["notice"], "session"])
        if len(m) > hot_rows:
            long |= m.groupby("session")["ts_ms"].transform("size") > hot_rows
        if not long.any():
            return m, None
        last = m[long].groupby("session", as_index=False)["ts_ms"].max().assign(uuid=None, parent=None, role=None, blank=False, notice=True)
        return pd.concat([m[~long], last[_HELD]], ignore_index=True), m[long & ~m["notice"]]

    def whole(frames: list[pd.DataFrame]) -> pd.DataFrame:
        m = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        return m.assign(blank=m["blank"].astype(bool), notice=m["notice"].astype(bool))

    def fold(key, parts, state: GroupState):
        if key[0] < 0:
            return
        mark = state.getCurrentWatermarkMs()
        pieces, held, due = state.get if state.exists else ([], 0, 2**62)
        pieces = [bytes(b) for b in pieces]
        new: list[pd.DataFrame] = []
        fresh = 0
        for p in parts if not state.hasTimedOut else ():
            hot = p["hot"].to_numpy(dtype=bool)
            if hot.any():
                yield _row(p[hot], True)
                p = p[~hot]
            if len(p):
                new.append(p[_HELD])
                fresh += len(p)
                due = min(due, int(p["ts_ms"].groupby(p["session"]).max().min()) + gap_ms)
            if fresh > hot_rows:
                m, gone = let_go(whole(new))
                if gone is not None and len(gone):
                    yield _row(gone, True)
                new, fresh = [m], 0
        if new:
            n = whole(new)
            if not n["notice"].any() and held + len(n) <= hot_rows and len(pieces) < PIECES and due > mark:
                state.update(([*pieces, _pack(n)], held + len(n), due))
                state.setTimeoutTimestamp(max(due, mark + 1))
                return
            new = [n]
        m = whole([*map(_unpack, pieces), *new]) if pieces or new else None
        if m is None:
            return
        m, gone = let_go(m)
        if gone is not None and len(gone):
            yield _row(gone, True)
        last = m.groupby("session")["ts_ms"].max()
        closed = m["session"].isin(last[last + gap_ms <= mark].index)
        done, rest = m[closed], m[~closed]
        if len(rest):
            due = int(last[last + gap_ms > mark].min()) + gap_ms
            state.update(([_pack(rest)], len(rest), due))
            state.setTimeoutTimestamp(max(due, mark + 1))
        elif state.exists:
            state.remove()
        if len(done):
            ended = done.loc[done["notice"], ["session"]].drop_duplicates()
            if len(ended):
                yield _row(ended, True, closed=True)
            numbered = sound_sessions(one_per_message(done[~done["session"].isin(ended["session"])]))
            if len(numbered):
                yield _row(numbered[["session", "uuid"]], False, seq_no=numbered["seq_no"].to_numpy())

    return fold


def conversation_stream(rows: DataFrame, buckets: int, gap_ms: int = GAP_MS, delay: str = DELAY, hot_rows: int = HOT_ROWS, local_rows: int = LOCAL_ROWS, marks: DataFrame | None = None) -> DataFrame:
    """A stream of raw transcript rows to a stream of messages of sound conversations (``hot`` false, numbered by ``seq_no``), of
    fragments of long ones (``hot``) and of marks that such a one is closed (``closed``); ``assembled`` puts these together.

    A row counts if it is no later than ``delay`` behind the latest one of the batches before; later ones are dropped. A session is
    closed once the watermark is ``gap_ms`` past its last message; what comes for it afterwards is another session of that name, which
    has no root and is not sound. ``marks`` is a stream of (ts) that moves the watermark on and counts for nothing else.
    """
    live = messages(rows).mapInPandas(lambda parts: _spread(parts, local_rows), _MESSAGE)
    by_message = F.xxhash64("session", "uuid")
    events = live.select("*", F.pmod(F.when(F.col("hot"), by_message).otherwise(F.xxhash64("session")), F.lit(buckets)).alias("bucket"))
    if marks is not None:
        blank = {f: F.lit(None).cast("string") for f in ("session", "uuid", "parent", "role")} | {f: F.lit(False) for f in ("blank", "hot", "notice")}
        # the mark has a bucket of its own: a filter would be pushed below the watermark
        events = events.unionByName(marks.select("ts", *[c.alias(n) for n, c in blank.items()], F.lit(-1).cast("long").alias("bucket")))
    keyed = events.withWatermark("ts", delay).select("bucket", "session", "uuid", "parent", "role", "blank", "hot", "notice", F.unix_millis("ts").alias("ts_ms"), "ts").groupBy("bucket")
    return keyed.applyInPandasWithState(_fold(gap_ms, hot_rows), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def assembled(emitted: DataFrame, ws: Workspace) -> DataFrame:
    """(session_id, seq_no, uuid) of the sound conversations among what ``conversation_stream`` wrote; long ones once they are closed."""
    numbered = emitted.where("not hot").select(F.col("session").alias("session_id"), "seq_no", "uuid")
    long = ws.save(emitted.where("hot and closed").select("session").distinct(), "long")
    if not long.limit(1).count():
        return numbered
    parts = emitted.where("hot and not closed").drop("hot", "closed", "seq_no")
    parts = skew_safe_lookup(parts, long.select("session", F.lit(True).alias("_closed")), "session", "inner").drop("_closed")
    alone = parts.where("uuid is null")
    once = parts.where("uuid is not null").groupBy("session", "uuid").agg(F.min("parent").alias("parent"), F.min("role").alias("role"), F.max("blank").alias("blank"))
    return numbered.unionByName(chained(ws.save(once.unionByName(alone), "fragments"), ws))


def _replay(spark: SparkSession, path: str, schema: StructType, files: int) -> tuple[DataFrame, int]:
    """The Parquet table at ``path``, a folder or a single file, as a stream, and the bytes of its files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    size = int(fs.getContentSummary(at).getLength())
    if fs.getFileStatus(at).isDirectory():
        return stream.parquet(path), size
    folder, _, name = path.rpartition("/")
    return stream.option("pathGlobFilter", name).parquet(folder), size


def conversations(
    spark: SparkSession, path: str, ws: Workspace, hot_rows: int = HOT_ROWS, local_rows: int = LOCAL_ROWS, bytes_per_bucket: int = BYTES_PER_BUCKET, gap_ms: int = GAP_MS, delay: str = REPLAY_DELAY, files: int = FILES_PER_BATCH
) -> DataFrame:
    """(session_id, seq_no, uuid) of every message of the sound conversations of the transcript rows at ``path``.

    The rows are replayed as a stream that ends, ``files`` files in a micro-batch; a last far-future mark on a second source lets the
    watermark pass every session, so each is emitted on closure. Null or unreadable times count as the earliest; repeated deliveries of
    a message count once (``one_per_message``); a message without an id makes its session unsound; an empty table gives no rows.
    """
    raw, size = _replay(spark, path, spark.read.parquet(path).schema, files)
    buckets = max(1, size // bytes_per_bucket)
    sink, progress, mark = ws.child("emitted"), ws.child("progress"), ws.child("mark")
    stamp = F.lit("2250-01-01 00:00:00").cast("timestamp").alias("ts")
    spark.range(0).select(stamp).write.parquet(mark)
    out = conversation_stream(raw, buckets, gap_ms, delay, hot_rows, local_rows, spark.readStream.schema("ts timestamp").parquet(mark))
    # more partitions of the state than keys would only be empty files; a query keeps the number that it starts with
    settings = ROCKSDB | {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets + 1))}
    before = {k: spark.conf.get(k, None) for k in settings}

    def run() -> None:
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        run()
        # all rows are in: the mark comes after the last of them, or rows of a later micro-batch would be late
        spark.range(1).select(stamp).write.mode("append").parquet(mark)
        run()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return assembled(spark.read.schema(_OUT).parquet(sink), ws)


def chained(fragments: DataFrame, ws: Workspace) -> DataFrame:
    """The sound ones among sessions whose messages (one row each) lie spread over many tasks, numbered like the others."""
    root = F.col("parent").isNull()
    bad = F.col("blank") | ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) | F.col("uuid").isNull() | (root & (F.col("role") != "user"))
    parts = fragments.groupBy("session").agg(F.count_if(root).alias("roots"), F.count_if(bad).alias("bad")).where("roots = 1 and bad = 0")
    ok = ws.save(parts.select("session", F.lit(True).alias("_ok")), "fine")
    if not ok.limit(1).count():
        return fragments.select(F.col("session").alias("session_id"), F.lit(0).alias("seq_no"), "uuid").limit(0)
    fine = skew_safe_lookup(fragments, ok, "session", "inner")
    m = ws.save(fine.select("session", F.concat_ws("/", "session", "uuid").alias("id"), F.when(~root, F.concat_ws("/", "session", "parent")).alias("parent"), "uuid", "role"), "links")
    tree = build_hierarchy(m, ws).select("id", "depth", "subtree_size")
    placed = ws.save(m.join(tree, "id").select("session", "uuid", "role", "depth", "subtree_size"), "placed")
    # one root that all hang from, one message per depth, each user message followed by an assistant one
    whole = placed.groupBy("session").agg(F.count("*").alias("n"), F.max("subtree_size").alias("size"), F.max("depth").alias("deepest"), F.min("depth").alias("least")).where("size = n and deepest = n - 1 and least = 0")
    alone = (
        placed.where("role = 'user'").select("session", (F.col("depth") + 1).alias("depth"))
        .join(placed.where("role = 'assistant'").select("session", "depth", F.lit(True).alias("reply")), ["session", "depth"], "left")
        .where("reply is null").select("session").distinct()
    )
    good = ws.save(whole.join(alone, "session", "left_anti").select("session", F.lit(True).alias("_good")), "good")
    return skew_safe_lookup(placed, good, "session", "inner").select(F.col("session").alias("session_id"), (F.col("depth") + 1).cast("int").alias("seq_no"), "uuid")
