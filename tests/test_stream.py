"""Growing logs, change feed, aging, late rows: small folders, drained with the availableNow trigger."""
import os

from pyspark.sql import functions as F

from sessionmill.operators import sets as T
from sessionmill.params import StatusParams
from sessionmill.sources.formats import generic
from sessionmill.streaming import aggregates as G
from sessionmill.streaming import deltas as D
from sessionmill.streaming.growing import EventSink, chunk_stream, complete_lines, split_complete


def drain(stream, sink, state, mode="append"):
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()


def test_partial_lines_wait():
    assert split_complete('{"a":1}\n{"b"') == ('{"a":1}\n', '{"b"')
    assert split_complete('{"a":1}') == ('{"a":1}', "")
    assert split_complete('{"a"') == ("", '{"a"')


def test_growing_file_continues_numbers(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    os.makedirs(src)
    put = lambda n, text: (src / f"log.jsonl.{n}.chunk").write_text(text)
    sink = EventSink(spark, str(out), generic.normalize)
    stream = lambda: complete_lines(chunk_stream(spark, str(src)))
    put(0, '{"type":"a"}\n{"type":"b"}\n{"ty')
    drain(stream(), sink, tmp_path / "state")
    put(1, 'pe":"c"}\n')
    put(2, '{"type":"d"}\n')
    drain(stream(), sink, tmp_path / "state")
    ev = sink.events().orderBy("index").collect()
    assert [(e["index"], e.raw_type) for e in ev] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert [e.offset for e in ev] == [0, 13, 26, 39] and ev[2].event_id == f"{ev[2].trace_id}:3:26"


def test_deltas_only_for_changes(spark, tmp_path):
    src = tmp_path / "in"
    schema = "trace_id string, event_id string, index bigint, ts_ms bigint"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))
    summarise = lambda e: e.groupBy("trace_id").agg(F.count("*").alias("event_count"), F.max("ts_ms").alias("last_ts_ms"))
    sink = D.DeltaSink(spark, str(tmp_path / "out"), summarise)
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
    put("a", [("t1", "t1:1", 1, 10), ("t2", "t2:1", 1, 20)])
    drain(stream(), sink, tmp_path / "state")
    put("b", [("t1", "t1:2", 2, 30)])
    drain(stream(), sink, tmp_path / "state")
    d = sink.deltas()
    assert d.select("version").distinct().count() == d.count()
    got = sorted((r.batch, r.trace_id, r.type, r.appended) for r in d.collect())
    assert [(g[1], g[2]) for g in got if g[0] == 0] == [("", "overview_updated"), ("t1", "events_appended"), ("t1", "trace_added"),
                                                       ("t2", "events_appended"), ("t2", "trace_added")]
    assert [(g[1], g[2], g[3]) for g in got if g[0] == 1] == [("", "overview_updated", None), ("t1", "events_appended", 1), ("t1", "trace_updated", None)]
    f = D.follow(d, "t1").orderBy("version").collect()
    assert [r.latest for r in f] == [["t1:1"], ["t1:2"]]
    # t1's file is rewritten and t9, which gave no session, vanishes: one removal, then t1 comes back with its new rows alone
    sink.reset(spark.createDataFrame([("t1", "rewritten"), ("t2", "same"), ("t9", "vanished")], "trace_id string, action string"), 1)
    put("c", [("t1", "t1:1", 1, 40), ("t2", "t2:2", 2, 50)])
    drain(stream(), sink, tmp_path / "state")
    d = sink.deltas()
    last = [(r.trace_id, r.type) for r in d.orderBy("version").collect() if r.version > 2**32 + 2**31 and r.type.startswith("trace")]
    assert last[0] == ("t1", "trace_removed") and set(last[1:]) == {("t1", "trace_added"), ("t2", "trace_updated")}
    assert d.select("version").distinct().count() == d.count()
    assert {r.trace_id: r.event_count for r in spark.read.parquet(str(tmp_path / "out/sessions/batch=2")).collect()} == {"t1": 1, "t2": 2}


def test_coalesced_batch(spark):
    rows = [(1, "trace_added", "a", None), (2, "events_appended", "a", 2), (3, "trace_updated", "a", None), (4, "events_appended", "a", 1),
            (5, "trace_removed", "b", None), (6, "trace_updated", "b", None), (7, "trace_added", "c", None), (8, "trace_removed", "c", None)]
    d = spark.createDataFrame([(*r, f"p{r[0]}") for r in rows], "version bigint, type string, trace_id string, appended bigint, payload string")
    got = {(r.trace_id, r.type): (r.version, r.first_version, r.appended, r.payload) for r in T.coalesced_deltas(d).collect()}
    assert got == {("a", "trace_added"): (3, 1, None, "p3"), ("a", "events_appended"): (4, 2, 3, "p4"),
                   ("b", "trace_updated"): (6, 5, None, "p6"), ("c", "trace_removed"): (8, 7, None, "p8")}


def test_append_to_page_and_stamp(spark):
    s = "event_id string, index bigint, ts_ms bigint, note string"
    page = spark.createDataFrame([("e2", 2, 20, "old"), ("e1", 1, 10, "old")], s)
    new = spark.createDataFrame([("e2", 2, 20, "new"), ("e3", 3, 15, "new")], s)
    assert [(r.event_id, r.note) for r in D.append_to_page(page, new).collect()] == [("e1", "old"), ("e3", "new"), ("e2", "old")]
    a = spark.createDataFrame([("t", 1, 5), ("u", 1, 5), ("v", 2, 5)], "trace_id string, event_count bigint, mtime_ms bigint")
    st = {r.trace_id: r.stamp for r in D.stamped(a).collect()}
    assert st["t"] == st["u"] != st["v"]


def test_affected_sessions(spark):
    paths = spark.createDataFrame([("/x/storage/session/p/s1.json",), ("/x/storage/message/s2/m.json",), ("/x/storage/session_diff/s3.json",),
                                   ("/x/storage/part/m9/p.json",)], "path string")
    parts = spark.createDataFrame([("/x/storage/part/m9/p.json", '{"sessionID":"s4"}'), ("/x/storage/part/m8/p.json", '{"sessionID":"s5"}')],
                                  "path string, j string").select("path", F.try_parse_json("j").alias("v"))
    assert {r.session_id for r in D.affected_sessions(paths, parts).collect()} == {"s1", "s2", "s3", "s4"}


def test_aging_steps():
    p = StatusParams(100, 1000)
    step = lambda *a: D.aging_step(*a, p)
    assert step("running", "recent_activity_fresh", 0, 1000, 1100) == ("running", "recent_activity_fresh")
    assert step("running", "recent_activity_fresh", 0, 1000, 1101) == ("waiting_input", "recent_activity_cooling")
    assert step("running", "recent_activity_fresh", 2, 1000, 1500) == ("running", "pending_tool_use_fresh")
    assert step("waiting_input", "explicit_wait_marker_fresh", 0, 1000, 2001) == ("idle", "stale_timeout")
    assert step("running", "x", 0, 0, 5) == ("idle", "stale_timeout")


def test_status_stream_ages(spark, tmp_path):
    import time
    src = tmp_path / "in"
    s = "trace_id string, status string, reason string, unmatched bigint, updated_ms bigint"
    now = int(time.time() * 1000)
    spark.createDataFrame([("t", "running", "recent_activity_fresh", 0, now), ("old", "running", "r", 0, 1)], s).coalesce(1).write.parquet(str(src))
    out = str(tmp_path / "out")
    aged = D.aged_statuses(spark.readStream.schema(s).parquet(str(src)), StatusParams(1, 600_000))
    # a query with processing-time timers never runs dry, so exactly one batch is asked for
    (aged.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).outputMode("update")
     .option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination(60))
    got = {r.trace_id: r.status for r in spark.read.parquet(out).collect()}
    assert got == {"t": "waiting_input", "old": "idle"}


def test_late_rows_are_kept_aside(spark, tmp_path):
    day = 86_400_000
    split = G.LateSplitter(spark, str(tmp_path / "o"), day)
    mk = lambda rows: spark.createDataFrame(rows, "trace_id string, ts_ms bigint")
    split(mk([("a", 10 * day)]), 0)
    split(mk([("a", 9 * day), ("b", 8 * day)]), 1)
    split(mk([("a", 9 * day), ("b", 8 * day)]), 1)  # a repeated batch changes nothing
    late = spark.read.parquet(str(tmp_path / "o" / "late"))
    assert [(r.trace_id, r.ts_ms) for r in late.collect()] == [("b", 8 * day)]
    assert G.with_late_rows(spark, str(tmp_path / "o")).count() == 3
