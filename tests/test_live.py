"""The live feed from kept state, and the job that feeds it from two listings."""
import json
import os
import shutil

from pyspark.sql import functions as F

from sessionmill.functions.ids import stable_id
from sessionmill.operators import sets as T
from sessionmill.sources import scan
from sessionmill.sources.formats import generic
from sessionmill.streaming import live as L

COLS = "trace_id string, index bigint, event_id string, ts_ms bigint, event_kind string, has_error boolean, tool_use_id string, is_wait boolean"


def put(spark, root, name, rows, generation=0, gone=()):
    df = L.event_rows(spark.createDataFrame(rows, COLS), generation)
    if gone:
        df = df.unionByName(L.removal_rows(spark.createDataFrame(gone, "trace_id string, generation bigint")))
    df.repartition(3).write.parquet(f"{root}/stream/{name}")


def feed(spark, root):
    return L.drain_live(spark.readStream.schema(L.EVENT).option("recursiveFileLookup", "true").parquet(f"{root}/stream"), root)


def ev(trace, i, kind="assistant", tool="", wait=False, error=False):
    return (trace, i, f"{trace}:{i}", 100 * i, kind, error, tool, wait)


def test_batches_read_their_own_rows_only(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, "a", [ev("t", 1, "user"), ev("t", 2, "tool_use", "x"), ev("u", 1)])
    feed(spark, root)
    shutil.rmtree(f"{root}/stream/a")      # history is gone, and the next batches need none of it
    put(spark, root, "b", [ev("t", i) for i in range(3, 60)] + [ev("t", 60, "tool_result", "x", error=True), ev("t", 61, wait=True)])
    feed(spark, root)
    shutil.rmtree(f"{root}/stream/b")
    put(spark, root, "c", [ev("t", 62, "tool_use", "y")])
    sink = feed(spark, root)
    d = sink.deltas().orderBy("version").collect()
    assert len({r.version for r in d}) == len(d)
    got = [(r.batch, r.trace_id, r.type, r.appended) for r in d]
    assert got[-2:] == [(2, "t", "events_appended", 1), (2, "", "overview_updated", None)] and (0, "u", "trace_added", None) in got
    at = {(r.batch, r.type): r for r in d if r.trace_id == "t"}
    assert [at[1, "events_appended"].latest[i] for i in (0, -1)] == ["t:22", "t:61"] and len(at[1, "events_appended"].latest) == T.LATEST_EVENTS
    assert (at[0, "trace_added"].unmatched_tool_uses, at[1, "trace_updated"].unmatched_tool_uses, at[2, "trace_updated"].unmatched_tool_uses) == (1, 0, 1)
    assert (at[1, "trace_updated"].pending_wait, at[2, "trace_updated"].pending_wait, at[2, "trace_updated"].event_count) == (True, False, 62)
    assert (at[2, "trace_updated"].first_ts_ms, at[2, "trace_updated"].last_ts_ms, at[2, "trace_updated"].error_count) == (100, 6200, 1)


def test_many_tool_ids_move_to_a_map(spark, tmp_path):
    root, n = str(tmp_path), 2 * L.INLINE + 10
    put(spark, root, "a", [ev("t", i, "tool_use", f"x{i}") for i in range(n)])
    feed(spark, root)
    put(spark, root, "b", [ev("t", n + i, "tool_result", f"x{i}") for i in range(n - 3)] + [ev("t", 9 * n, "tool_use", "x0"), ev("t", 9 * n + 1, "tool_use", "new")])
    feed(spark, root)
    put(spark, root, "c", [ev("t", 1, "tool_use", "z")], 1)
    d = feed(spark, root).deltas().filter("type LIKE 'trace%'").orderBy("version").collect()
    assert [(r.type, r.unmatched_tool_uses, r.event_count) for r in d] == [("trace_added", n, n), ("trace_updated", 4, 2 * n - 1), ("trace_updated", 1, 1)]


def test_a_hot_session_reaches_its_state_folded(spark):
    many = spark.range(30_000).select(F.lit("hot").alias("trace_id"), F.col("id").alias("index"), F.concat(F.lit("e"), "id").alias("event_id"), F.col("id").alias("ts_ms"),
                                      F.lit("assistant").alias("event_kind"), F.lit(False).alias("has_error"), F.lit("").alias("tool_use_id"))
    rows = L.folded(L.event_rows(many)).collect()
    assert len(rows) <= 16 and sum(r.event_count for r in rows) == 30_000 and all(len(r.newest) <= T.LATEST_EVENTS for r in rows)


def test_a_task_folds_its_sessions_to_a_row_each(spark):
    """Sessions whose rows lie among those of many others: a row each per task, whatever the Arrow batches; the values are those of all rows."""
    i, n = F.col("id"), 1_000
    rows = spark.range(0, 24_000, 1, 2).select(
        F.when(i % 997 != 0, F.concat(F.lit("s"), i % n)).alias("trace_id"), (i * 7919 % 24_001).alias("index"), F.when(i % 5 != 0, F.concat(F.lit("e"), i)).alias("event_id"),
        F.when(i % 4 != 0, i * 10).alias("ts_ms"), F.element_at(F.array(*map(F.lit, ("user", "assistant", "tool_use", "tool_result", None))), (F.floor(i / n) % 5 + 1).cast("int")).alias("event_kind"),
        (i % 3 == 0).alias("has_error"), F.when(i % 2 == 0, F.concat(F.lit("t"), F.floor(i / 3000))).alias("tool_use_id"), (i % 11 == 0).alias("is_wait"))
    kept = L.event_rows(rows).unionByName(L.removal_rows(spark.createDataFrame([("s1", 0), ("gone", 3)], "trace_id string, generation bigint"))).coalesce(2)
    got = L.folded(kept).collect()
    assert len([r for r in got if not r.gone]) <= 2 * n and sorted((r.trace_id, r.generation, r.event_count, r.first_index) for r in got if r.gone) == [("gone", 3, 0, None), ("s1", 0, 0, None)]
    want = {r.trace_id: r for r in rows.filter("trace_id IS NOT NULL").groupBy("trace_id").agg(
        F.count("*").alias("n"), F.count_if("has_error").alias("errors"), F.count_if(F.col("event_kind") == "tool_use").alias("uses"),
        F.expr("min_by(ts_ms, index) FILTER (WHERE ts_ms IS NOT NULL)").alias("first"), F.expr("max_by(ts_ms, index) FILTER (WHERE ts_ms IS NOT NULL)").alias("last"),
        F.expr("max(index) FILTER (WHERE is_wait OR event_kind IN ('user', 'tool_use', 'tool_result'))").alias("told"),
        F.expr("max_by(coalesce(event_kind NOT IN ('user', 'tool_use', 'tool_result'), true), index) FILTER (WHERE is_wait OR event_kind IN ('user', 'tool_use', 'tool_result'))").alias("waits"),
        F.expr("collect_set(tool_use_id) FILTER (WHERE event_kind = 'tool_result')").alias("answered"),
        F.expr("sort_array(collect_list(struct(index, event_id)) FILTER (WHERE event_id IS NOT NULL))").alias("newest")).collect()}
    assert len(want) == n
    for trace, w in want.items():
        some = [r for r in got if r.trace_id == trace and not r.gone]
        assert (sum(r.event_count for r in some), sum(r.error_count for r in some), sum(r.tool_use_count for r in some)) == (w.n, w.errors, w.uses)
        timed, told = [r for r in some if r.first_index is not None], [r for r in some if r.telling_index is not None]
        assert min(((r.first_index, r.first_ts_ms) for r in timed), default=(0, None))[1] == w["first"] and max(((r.last_index, r.last_ts_ms) for r in timed), default=(0, None))[1] == w["last"]
        assert max(((r.telling_index, r.telling_waits) for r in told), default=(None, None)) == (w.told, w.waits)
        assert sorted({t for r in some for t in r.answered}) == sorted(w.answered) and all(r.used == sorted(set(r.used)) for r in some)
        assert sorted(x for r in some for x in zip(r.newest_index, r.newest)) == [tuple(x) for x in w.newest]


def test_generations_replace_and_remove(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, "a", [ev("t", 1), ev("t", 2), ev("u", 1), ev("w", 1)])
    feed(spark, root)
    put(spark, root, "b", [ev("t", 1, "user")], 1, [("u", 1), ("nobody", 1)])
    put(spark, root, "b2", [ev("w", 9)], 2, [("w", 1)])
    feed(spark, root)
    put(spark, root, "c", [ev("t", 5)], 0)           # of a generation that is over
    put(spark, root, "c2", [ev("u", 1), ev("u", 2)], 2)
    d = feed(spark, root).deltas().orderBy("version").collect()
    by = lambda b, t: [(r.type, r.appended, r.event_count) for r in d if r.batch == b and r.trace_id == t]
    assert by(1, "t") == [("trace_updated", None, 1)] and by(1, "u") == [("trace_removed", None, 1)] and by(1, "nobody") == []
    assert by(1, "w") == [("trace_removed", None, 1), ("trace_added", None, 1), ("events_appended", 1, 1)]
    assert by(2, "t") == [] and by(2, "u") == [("trace_added", None, 2), ("events_appended", 2, 2)]


def test_listings_feed_the_stream(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "work")
    os.makedirs(logs)
    line = lambda n: json.dumps({"type": "user", "text": f"m{n}"}) + "\n"
    write = lambda name, ns, t: ((logs / name).write_text("".join(map(line, ns))), os.utime(logs / name, (t, t)))
    parsed = []

    def parse(paths):
        parsed.append(sorted(os.path.basename(p) for p in paths))
        return generic.normalize(scan.json_rows(scan.lines(spark, paths)))
    job = L.LiveFiles(spark, root, parse)
    listing = lambda: scan.log_files(spark, [str(logs)])
    run = lambda n: {r.trace_id: r.action for r in job.refresh(listing(), n).collect()}
    ids = {n: spark.range(1).select(stable_id(F.lit(str(logs / n)), F.lit(""))).first()[0] for n in ("a.jsonl", "b.jsonl", "c.jsonl", "d.jsonl")}
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        write(name, range(3), 1_000_000)
    assert set(run(0).values()) == {"new"}
    L.drain_live(job.stream(), root)
    write("a.jsonl", range(5), 1_000_010)            # grown
    write("b.jsonl", [7], 1_000_010)                 # rewritten
    os.remove(logs / "c.jsonl")
    write("d.jsonl", [1], 1_000_010)
    assert run(1) == {ids["a.jsonl"]: "grown", ids["b.jsonl"]: "rewritten", ids["c.jsonl"]: "vanished", ids["d.jsonl"]: "new"}
    L.drain_live(job.stream(), root)
    write("c.jsonl", [1, 2], 1_000_020)              # comes back
    assert run(2)[ids["c.jsonl"]] == "new"
    sink = L.drain_live(job.stream(), root)
    assert parsed == [["a.jsonl", "b.jsonl", "c.jsonl"], ["a.jsonl", "b.jsonl", "d.jsonl"], ["c.jsonl"]]
    d = sink.deltas().orderBy("version").collect()
    by = lambda b, n: [(r.type, r.appended, r.event_count) for r in d if r.batch == b and r.trace_id == ids[n]]
    assert by(1, "a.jsonl") == [("trace_updated", None, 5), ("events_appended", 2, 5)] and by(1, "b.jsonl") == [("trace_updated", None, 1)]
    assert by(1, "c.jsonl") == [("trace_removed", None, 3)] and by(1, "d.jsonl") == [("trace_added", None, 1), ("events_appended", 1, 1)]
    assert by(2, "c.jsonl") == [("trace_added", None, 2), ("events_appended", 2, 2)] and by(2, "a.jsonl") == []


def test_latest_events_of_all_appends_are_merged(spark):
    rows = [(1, "events_appended", "a", 2, ["e1", "e2"]), (4, "events_appended", "a", 2, ["e2", "e3"]), (3, "events_appended", "b", 1, []), (2, "trace_updated", "a", None, [])]
    d = spark.createDataFrame([(*r, "p") for r in rows], "version bigint, type string, trace_id string, appended bigint, latest array<string>, payload string")
    got = {(r.trace_id, r.type): (r.appended, r.latest) for r in T.coalesced_deltas(d).collect()}
    assert got == {("a", "events_appended"): (4, ["e1", "e2", "e3"]), ("b", "events_appended"): (1, []), ("a", "trace_updated"): (None, [])}
