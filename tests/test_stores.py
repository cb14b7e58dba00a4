"""Stores that rewrite what a run touches, late rows folded into them, and a changed file deriving its session again."""
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sessionmill.operators.segments import active_segments
from sessionmill.plans.ingest import read_entities
from sessionmill.sources import scan
from sessionmill.streaming import aggregates as G
from sessionmill.streaming import invalidation as I
from sessionmill.streaming import stores as S

MIN = 60_000


def test_a_run_rewrites_what_it_touches_and_only_once(spark, tmp_path):
    st = S.PartitionStore(spark, str(tmp_path), "k string, n bigint")
    put = lambda run, rows: st.rewrite(run, sorted({r[2] for r in rows}), lambda old: old.unionByName(spark.createDataFrame(rows, "k string, n bigint, bucket int")))
    assert put(4, [("a", 1, 0), ("b", 2, 1)]) and not put(4, [("a", 1, 0)])
    before = st.manifest()
    assert put(2, [("c", 3, 1)])               # an earlier number, a later commit
    assert st.manifest() == {0: before[0], 1: 2} and sorted(map(tuple, st.read().collect())) == [("a", 1, 0), ("b", 2, 1), ("c", 3, 1)]
    assert st.rewrite(5, [1], lambda old: old.filter("k = 'none'")) and [r.k for r in st.read().collect()] == ["a"] and st.read([1]).count() == 0
    assert st.vacuum() == 2 and [r.k for r in st.read().collect()] == ["a"]


def test_segments_merge_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(4)}", 1_700_000_000_000 + rng.randrange(3_000) * MIN) for _ in range(700)] + [("hot", 1_700_000_000_000 + i * 7 * MIN) for i in range(300)]
    rng.shuffle(rows)
    ev = lambda r: spark.createDataFrame(r, "trace_id string, ts_ms bigint")
    st = S.SegmentStore(spark, str(tmp_path), buckets=4)
    for run, part in enumerate((rows[:500], rows[500:505], rows[505:])):
        assert st.add_events(run, ev(part)) and not st.add_events(run, ev(part))
    want = active_segments(ev(rows)).select("trace_id", "start_ms", "end_ms", "n_events")
    assert sorted(map(tuple, st.read().collect())) == sorted(map(tuple, want.collect()))


def test_untouched_partitions_stay_where_they_are(spark, tmp_path):
    st = S.SegmentStore(spark, str(tmp_path), buckets=16)
    ev = lambda r: spark.createDataFrame(r, "trace_id string, ts_ms bigint")
    st.add_events(0, ev([(f"t{i}", 1_700_000_000_000) for i in range(200)]))
    st.add_events(1, ev([("t7", 1_700_000_000_000 + 5 * MIN)]))
    assert sorted(st.store.manifest().values()) == [0] * 15 + [1]


def test_late_rows_are_repaired_with_ordinary_ones_between(spark, tmp_path):
    """Late rows before a segment is closed, between its events, joining two, and alone; a late session of a bin counts once."""
    day = 86_400_000
    t0 = 1_700_000_000_000
    s = "trace_id string, ts_ms bigint, agent string"
    batches = [[("a", t0), ("a", t0 + 15 * MIN), ("b", t0 + 60 * MIN)], [("b", t0 + 100 * MIN), ("z", t0 + 2 * day)],
               [("a", t0 + 30 * MIN), ("b", t0 + 80 * MIN), ("c", t0 + MIN), ("z", t0 + 2 * day + MIN)], [("z", t0 + 9 * day), ("a", t0 + 31 * MIN)]]
    kept = G.Repaired(spark, str(tmp_path / "kept"), spark.createDataFrame([], s).schema)
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r, "g") for r in rows], s).repartition(2).write.parquet(str(tmp_path / f"in/{i}"))
        source = spark.readStream.schema(s).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        kept.advance(source)
        kept.advance(source)                   # nothing new
    rows = [r for b in batches for r in b if r[1] < t0 + 9 * day]
    want = active_segments(spark.createDataFrame([r for r in rows], "trace_id string, ts_ms bigint")).select("trace_id", "start_ms", "end_ms", "n_events")
    assert sorted(map(tuple, kept.segments.read().collect())) == sorted(map(tuple, want.collect()))
    bins = {}
    for t, ms in rows:
        bins.setdefault(ms // 300_000 * 300_000, []).append(t)
    assert {r.start_ms: (r.sessions, r.events) for r in kept.bins.read().collect()} == {k: (len(set(v)), len(v)) for k, v in bins.items()}


def test_changed_files_derive_their_sessions_alone(spark, tmp_path, monkeypatch):
    root, n = tmp_path / "h", [1_000_000]

    def put(name, **body):
        n[0] += 10
        p = root / "storage" / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_text(body.pop("raw", None) or json.dumps(body))
        os.utime(p, (n[0], n[0]))
    os.makedirs(root / "storage/session_diff")
    for s in "abcde":
        put(f"session/p/{s}.json", id=s, title=f"T{s}")
        put(f"message/{s}/m{s}.json", id=f"m{s}", role="user", time={"created": 5})
        put(f"part/m{s}/p.json", id="p", type="text", text=f"text {s}")
    put("part/later/p.json", id="p", type="text", text="waits")
    kept = I.SessionFiles(spark, str(tmp_path / "kept"), buckets=3)
    listing = lambda: scan.log_files(spark, [str(root)])
    ids = lambda run: sorted(r.session_id for r in kept.refresh(listing(), run).collect())
    columns = ("trace_id", "index", "event_kind", "preview", "ts_ms", "raw_json", "event_id")

    def check():
        want = read_entities(spark, str(root), 0, diffs=True).events
        assert sorted(map(tuple, kept.read().select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert ids(0) == list("abcde")
    check()
    assert ids(1) == [] and set(kept.events.manifest().values()) <= {0}
    put("part/mb/p.json", id="p", type="text", text="other text")               # a changed part
    os.remove(root / "storage/part/mc/p.json")                                  # a part that vanishes
    put("message/d/later.json", id="later", role="assistant", time={"created": 9})   # the message that a part waited for
    put("part/me/q.json", raw="{half")                                          # being written
    assert ids(2) == ["b", "c", "d"]
    check()
    put("part/me/q.json", id="q", type="text", text="whole now")
    put("session_diff/f.json", files=[])
    os.remove(root / "storage/session/p/a.json")
    os.remove(root / "storage/message/b/mb.json")                               # its parts have no message any more

    def broken(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:                                            # the run fails after two of its stores are written
        m.setattr(I.SessionFiles, "_normalized", broken)
        with pytest.raises(RuntimeError):
            ids(3)
    assert ids(3) == ["a", "b", "e", "f"]
    check()
    assert ids(4) == []


def test_changed_files_are_opened_by_tasks(spark, tmp_path, monkeypatch):
    from sessionmill.sources import scan
    from sessionmill.streaming import invalidation
    monkeypatch.setattr(invalidation, "PATHS", 0)     # no name may pass the driver
    for i in range(3):
        path = tmp_path / f"files/storage/session/p/s{i}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text('{"id": "s%d", "title": "t"}' % i)
    kept = invalidation.SessionFiles(spark, f"{tmp_path}/kept", buckets=2)
    assert kept._read(scan.log_files(spark, [f"{tmp_path}/files"])).count() == 3
