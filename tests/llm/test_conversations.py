import os

import pytest

from parleyworks.llm.conversations import assembled, conversation_stream, conversations, one_per_message

SCHEMA = "type string, timestamp string, uuid string, parentUuid string, isSidechain boolean, sessionId string, message struct<role:string,content:string>, session string, ts string"


def msg(session, uuid, parent, role="user", content="x", side=False, ts="2026-01-01T00:00:00Z", kind=None):
    return (kind or role.strip().lower(), ts, uuid, parent, side, session, (role, content), "clash", "clash")


CASES = [
    *[msg("ok", f"o{k}", f"o{k - 1}" if k else None, "user" if k % 2 == 0 else "assistant", ts=f"2026-01-01T0{9 - k}:00:00Z") for k in range(6)],
    msg(" OK ", "O1", " O0", "Assistant"),  # a repeated delivery in another spelling
    msg("two", "w0", None), msg("two", "w1", "w0", "assistant"), msg("two", "w2", "w1", " ASSISTANT ", '[{"type": "tool_use", "name": "x"}]', ts=None),
    msg("noreply", "n0", None), msg("noreply", "n1", "n0", "assistant"), msg("noreply", "n2", "n1"),
    msg("branch", "b0", None), msg("branch", "b1", "b0", "assistant"), msg("branch", "b2", "b0", "assistant"),
    msg("roots", "r0", None), msg("roots", "r1", "r0", "assistant"), msg("roots", "r2", " "), msg("roots", "r3", "r2", "assistant"),
    msg("gap", "g0", None), msg("gap", "g1", "elsewhere", "assistant"),
    msg("blank", "k0", None), msg("blank", "k1", "k0", "assistant", '[{"type": "text", "text": "  \\n"}]'),
    msg("empty", "e0", None), msg("empty", "e1", "e0", "assistant", " [ ] "),
    msg("null", "u0", None), msg("null", "u1", "u0", "assistant", None),
    msg("role", "l0", None), ("assistant", "2026", "l1", "l0", False, "role", ("system", "x"), "", ""),
    msg("first", "f0", None, "assistant"),
    msg("side", "s0", None), msg("side", "s1", "s0", "assistant"), msg("side", "s2", "s1", "assistant", side=True),
    msg("loop", "p0", None), msg("loop", "p1", "p2", "assistant"), msg("loop", "p2", "p1", "assistant"),
    msg("noid", "i0", None), msg("noid", None, "i0", "assistant"),
    msg(None, "z0", None), msg(" ", "z1", "z0", "assistant"),
    msg("old", "d0", None, ts="1960-01-01T00:00:00Z"), msg("old", "d1", "d0", "assistant", ts="not a time"),
    msg("ok", "other", None, kind="summary"),
]
WANT = sorted([*[("ok", k + 1, f"o{k}") for k in range(6)], *[("two", k + 1, f"w{k}") for k in range(3)], ("side", 1, "s0"), ("side", 2, "s1"), ("old", 1, "d0"), ("old", 2, "d1")])


@pytest.mark.parametrize("hot,local", [(20_000, 4_000), (2, 4_000), (20_000, 2)])
@pytest.mark.parametrize("files,batch", [(1, 64), (3, 1)])
def test_cases(spark, ws, tmp_path, hot, local, files, batch):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(CASES, SCHEMA).repartition(files).write.parquet(path)
    got = conversations(spark, path, ws, hot_rows=hot, local_rows=local, bytes_per_bucket=2_000, files=batch)
    assert sorted(tuple(r) for r in got.select("session_id", "seq_no", "uuid").collect()) == WANT


def test_empty(spark, ws, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert conversations(spark, path, ws).count() == 0


def live(spark, tmp_path, deliveries, **options):
    """What a live stream emits by batch: each delivery is a file that comes after the one before."""
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    os.makedirs(source)
    seen, emitted = set(), []
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = conversation_stream(spark.readStream.schema(SCHEMA).parquet(source), 3, **options)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        now = {tuple(r) for r in spark.read.parquet(sink).select("session", "seq_no", "uuid").collect()}
        emitted.append(sorted(now - seen))
        seen = now
    return emitted, spark.read.parquet(sink)


def test_late_rows_a_timeout_and_a_row_beyond_the_watermark(spark, tmp_path):
    at = "2026-01-{:02d}T{:02d}:00:00Z".format
    deliveries = [
        [msg("a", "a0", None, ts=at(1, 0)), msg("a", "a2", "a1", ts=at(1, 2)), msg("b", "b0", None, ts=at(1, 0))],
        # two days on; late, but within the delay
        [msg("a", "a1", "a0", "assistant", ts=at(1, 1)), msg("c", "c0", None, ts=at(3, 0)), msg("a", "a3", "a2", "assistant", ts=at(1, 3))],
        # ten days on: the watermark passes a and b only after this batch
        [msg("d", "d0", None, ts=at(13, 0)), msg("c", "c1", "c0", "assistant", ts=at(3, 1))],
        # beyond the watermark (7 days before the 13th): dropped, so b stays without a reply
        [msg("b", "b1", "b0", "assistant", ts=at(1, 1)), msg("d", "d1", "d0", "assistant", ts=at(13, 1))],
        [msg("e", "e0", None, ts=at(25, 0))],
    ]
    emitted, _ = live(spark, tmp_path, deliveries)
    a, c, d = [("a", k + 1, f"a{k}") for k in range(4)], [("c", 1, "c0"), ("c", 2, "c1")], [("d", 1, "d0"), ("d", 2, "d1")]
    assert emitted[:2] == [[], []] and sorted(sum(emitted, [])) == a + c + d
    # a closes by a timeout, without a row of its own; d only after the last delivery
    assert set(a + c) <= set(sum(emitted[2:4], [])) and emitted[4] == d


def test_long_sessions_of_a_live_stream(spark, ws, tmp_path):
    at = "2026-01-01T00:{:02d}:{:02d}Z".format
    rows = [msg("long", f"l{k}", f"l{k - 1}" if k else None, "user" if k % 2 == 0 else "assistant", ts=at(k // 60, k % 60)) for k in range(100)]
    deliveries = [rows[::-1][:60], rows[30:50] + rows[:20] + rows[40:60], rows[20:40], [msg("end", "e0", None, ts="2026-03-01T00:00:00Z")]]
    emitted, out = live(spark, tmp_path, deliveries, hot_rows=30, local_rows=15)
    assert out.where("closed").count() == 1
    assert sorted(map(tuple, assembled(out, ws).collect())) == sorted(("long", k + 1, f"l{k}") for k in range(100))


def test_deliveries_that_differ_count_by_a_stated_order():
    import pandas as pd

    m = pd.DataFrame({"session": ["s"] * 4, "uuid": ["x", "x", "y", None], "parent": ["b", None, None, "q"], "role": ["user", "assistant", "user", None], "blank": [False, True, False, False], "notice": [False] * 4, "ts_ms": [1, 5, 2, 3]})
    for order in (m, m[::-1].reset_index(drop=True)):
        got = one_per_message(order)
        assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, [["s", "x", "b", "assistant", True, False, 5], ["s", "y", None, "user", False, False, 2], ["s", None, "q", None, False, False, 3]]))
