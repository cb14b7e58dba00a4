"""Chunked operators against plain windows, on groups that are cut into many chunks; order and split independence."""
import random

import pytest
from pyspark.sql import Window as W, functions as F

from sessionmill.operators import lanes as LN
from sessionmill.operators.ordered import dense_index, global_rank, running
from sessionmill.operators.redact import redact_events
from sessionmill.operators.segments import active_segments
from sessionmill.params import RedactionParams, hour_window_minutes, window_ms_of
from sessionmill.sources import scan
from sessionmill.sources.formats.registry import DEFAULT_FORMATS, Format, FormatRegistry

from . import logs as L


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows belong to one key."""
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.66 else f"k{rnd.randrange(5)}", i, rnd.choice([None, rnd.randrange(100)])) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, i bigint, x bigint").repartition(7)


@pytest.mark.parametrize("chunk", [1, 17, 100_000])
def test_running_equals_window(spark, skewed, chunk):
    w = W.partitionBy("k").orderBy("i")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    x = F.col("x")
    want = skewed.select("k", "i", F.last(x, True).over(upto).alias("l"), F.last(x, True).over(before).alias("lb"), F.first(x, True).over(upto).alias("f"),
                         F.coalesce(F.sum(x).over(upto), F.lit(0)).alias("s"), F.lag(x).over(w).alias("g"), F.row_number().over(w).cast("bigint").alias("n"))
    got = running(skewed, ["k"], "i", {"l": ("last", x), "lb": ("last_before", x), "f": ("first", x), "s": ("sum", x), "g": ("lag", x),
                                       "n": ("count", None)}, chunk).select("k", "i", "l", "lb", "f", "s", "g", "n")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_segments_do_not_depend_on_the_split(spark):
    rnd = random.Random(3)
    rows = [("a" if rnd.random() < 0.7 else "b", rnd.randrange(1, 10**8)) for _ in range(800)]
    df = spark.createDataFrame(rows, "trace_id string, ts_ms bigint")
    want = []
    for t in ("a", "b"):
        seg = []
        for ts in sorted(x for k, x in rows if k == t):
            if seg and ts - seg[-1][1] <= 1_200_000:
                seg[-1][1] = ts
                seg[-1][2] += 1
            else:
                seg.append([ts, ts, 1])
        want += [(t, *s) for s in seg]
    for parts in (1, 5):
        got = active_segments(df.repartition(parts)).select("trace_id", "start_ms", "end_ms", "n_events").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_global_rank(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 3).repartition(6)
    got = [(r.rank, r.v, r.id) for r in global_rank(df, [F.desc("v"), F.asc("id")]).orderBy("rank").collect()]
    want = sorted(((i % 3, i) for i in range(1000)), key=lambda t: (-t[0], t[1]))
    assert [g[0] for g in got] == list(range(1, 1001)) and [(g[1], g[2]) for g in got] == want


def test_lanes_equal_first_fit(spark):
    rnd = random.Random(5)
    bars = [(d, f"t{i:03d}", s, s + rnd.randrange(0, 6)) for d in (0, 1) for i in range(60) for s in [rnd.randrange(0, 80)]]
    want = []
    for d in (0, 1):
        ends = []
        for _, t, s, e in sorted((b for b in bars if b[0] == d), key=lambda b: (b[2], b[1])):
            lane = next((i for i, x in enumerate(ends) if s > x), len(ends))
            ends[lane:lane + 1] = [e]
            want.append((d, t, s, e, lane))
    df = spark.createDataFrame(bars, "day int, trace_id string, first_bin int, last_bin int")
    got = LN.assign_lanes(df, ["day"]).select("day", "trace_id", "first_bin", "last_bin", "lane").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_lines_keep_place_over_splits(spark, tmp_path):
    lines = [f'{{"n":{i},"pad":"{"x" * (i % 13)}"}}' if i % 4 else "" for i in range(400)]
    L.write_lines(f"{tmp_path}/a.jsonl", lines, end="", sep="\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = scan.lines(spark, [str(tmp_path)]).orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    at, want = 0, []
    for i, line in enumerate(lines):
        want.append((i + 1, at, line))
        at += len(line) + 1
    # an empty last line is no line to the reader
    assert [(r.row_no, r.offset, r.line) for r in got] == [w for w in want if w[0] <= len(got)] and len(got) >= 399


def test_redaction_masks_nested_secrets(spark):
    cols = "preview string, raw_type string, text_blocks array<string>, tool_args_text string, tool_result_text string, toc_label string, raw_json string, search_text string"
    row = ("use sk-abc1", "x", ["a sk-zz9"], "", "", "l", '{"token":"sk-secret-123","a":{"OPENAI_API_KEY":"v","ok":true,"n":["ghp_abc"]}}', "old")
    r = redact_events(spark.createDataFrame([row], cols)).first()
    assert r.preview == "use [REDACTED]" and r.text_blocks == ["a [REDACTED]"] and "sk-" not in r.search_text
    assert r.raw_json == '{"token":"[REDACTED]","a":{"OPENAI_API_KEY":"[REDACTED]","ok":true,"n":["[REDACTED]"]}}'
    off = redact_events(spark.createDataFrame([row], cols), RedactionParams(mode="off", always_on=False)).first()
    assert off.preview == "use sk-abc1"
    bad = redact_events(spark.createDataFrame([row], cols), RedactionParams(value_pattern="(")).first()
    assert bad.preview == "use [REDACTED]"


def test_registry_takes_new_formats(spark):
    mine = Format("mine", "mine", lambda p, h: F.when(h.contains("mine!"), F.lit("0.9").cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)")), None)
    r = FormatRegistry().register(mine)
    df = spark.createDataFrame([("/a.jsonl", "MINE! x"), ("/b.jsonl", "?"), ("/h/.codex/sessions/x.jsonl", "?")], "path string, head string")
    assert [x.f for x in df.select(r.choose(F.col("path"), F.col("head")).alias("f")).collect()] == ["mine", "codex", "codex"]
    assert [f.name for f in r.formats][-1] == "generic" and len(r.formats) == len(DEFAULT_FORMATS) + 1


def test_discovery_rules(spark):
    assert scan.convention_globs("~/.gemini/tmp", "gemini") == ("**/chats/session-*.json", "**/*.jsonl")
    paths = ["/h/.claude/projects/p/a.jsonl", "/h/.claude/projects/p/subagents/agent-acompact-1.jsonl", "/h/.claude/history.jsonl",
             "/h/.local/share/opencode/storage/session/p/s1.json", "/h/.local/share/opencode/storage/session_diff/s1.json",
             "/h/.local/share/opencode/storage/session_diff/s2.json", "/h/x.jsonl"]
    df = spark.createDataFrame([(p, str(i), 0) for i, p in enumerate(paths)], "path string, trace_id string, mtime_ms bigint")
    got = {r.trace_id: r.source_profile for r in scan.without_superseded_diffs(scan.discover(df, home="/h")).collect()}
    assert got == {"0": "session_log", "2": "claude_history", "3": "session_log", "5": "session_log"}


def test_parameters():
    assert [hour_window_minutes(*h) for h in ((0, 24), (7, 7), (6, 2), (9, 17))] == [1440, 1440, 1200, 480]
    assert window_ms_of("24h") == 86_400_000
    with pytest.raises(ValueError):
        window_ms_of("soon")
