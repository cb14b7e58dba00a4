"""Known results on small logs, through files, format jobs, usage rows and summaries."""
import pytest
from pyspark.sql import functions as F

from sessionmill.operators import activity as A
from sessionmill.operators import pricing as P
from sessionmill.operators import usage_rows as U
from sessionmill.operators.segments import active_segments
from sessionmill.params import day_plan
from sessionmill.plans.ingest import read_entities, read_logs

from . import logs as L

NOW = 1_800_000_000_000


def rates(spark, *rows):
    return P.rate_table(spark, tuple(r + (None,) * (17 - len(r)) for r in rows))


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


@pytest.fixture(scope="module")
def codex_logs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("codex")
    base = f"{root}/.codex/sessions/2026/02/13"
    L.write_lines(f"{base}/rollout-a.jsonl", [
        L.codex_meta("sess-1"),
        {"timestamp": "2026-02-13T11:00:01Z", "type": "response_item", "payload": {
            "type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}},
        {"timestamp": "2026-02-13T11:00:02Z", "type": "response_item", "payload": {
            "type": "function_call", "name": "exec_command", "call_id": "c1", "arguments": "{\"cmd\":\"ls\"}"}},
        {"timestamp": "2026-02-13T11:00:03Z", "type": "response_item", "payload": {
            "type": "function_call_output", "call_id": "c1", "output": "ok"}},
        L.codex_model("gpt-5.3-codex")])
    L.write_lines(f"{base}/rollout-b.jsonl", [
        L.codex_meta("sess-cached"), L.codex_model("gpt-5.3-codex"),
        L.codex_count((1000, 900, 0, 0, 1000), (1000, 900, 0, 0, 1000), 10000, "2026-02-13T11:00:02Z")])
    L.write_lines(f"{base}/rollout-c.jsonl", [
        L.codex_meta("sess-tier"), L.codex_model("gpt-5.4-2026-02-28"),
        L.codex_count((100_000, 10_000, 10_000, 0, 120_000), (100_000, 10_000, 10_000, 0, 120_000), 1_050_000, "2026-02-13T12:00:02Z"),
        L.codex_count((400_000, 30_000, 20_000, 0, 450_000), (300_000, 20_000, 10_000, 0, 330_000), 1_050_000, "2026-02-13T12:00:03Z")])
    r = rates(spark, ("gpt-5.3-codex", 1.0, 0.0, 0.0, 0.0, None, None, 0.0),
              ("gpt-5.4", 1.25, 7.5, 0.125, 0.0, None, None, 0.0, 272_000, 2.5, 11.25))
    return read_logs(spark, [f"{root}/.codex"], NOW, rates=r)


def test_codex_session(codex_logs):
    s = one(codex_logs.sessions.filter("session_id = 'sess-1'"))
    assert (s.event_count, s.tool_use_count, s.tool_result_count, s.unmatched_tool_uses) == (5, 1, 1, 0)
    assert [(t["name"], t["count"]) for t in s.top_tools] == [("exec_command", 1)]
    assert s.event_kind_counts == {"system": 0, "assistant": 0, "user": 1, "tool_use": 1, "tool_result": 1, "reasoning": 0,
                                   "compaction": 0, "meta": 2}
    assert s.agent == "codex" and s.parseable and s.activity_status == "idle"
    types = codex_logs.events.filter("session_id = 'sess-1' AND event_kind LIKE 'tool%'").select("tool_type").distinct().collect()
    assert [t.tool_type for t in types] == ["bash"]


def test_codex_cached_input_is_billed_once(codex_logs):
    s = one(codex_logs.sessions.filter("session_id = 'sess-cached'"))
    assert float(s.cost_usd) == 0.0001


def test_codex_long_context_tier_per_row(codex_logs):
    s = one(codex_logs.sessions.filter("session_id = 'sess-tier'"))
    assert float(s.cost_usd) == 1.06625
    assert s.context_window_pct == pytest.approx(30.47619, abs=1e-5)
    assert (s.total_tokens, s.input_tokens) == (450_000, 400_000)
    assert s.model_token_shares_estimated and s.model_token_shares_top[0]["tokens"] == 450_000


def test_claude_requests_count_once(spark, tmp_path):
    m = "claude-sonnet-4-5-20250929"
    L.write_lines(f"{tmp_path}/.claude/projects/p/a.jsonl", [
        L.claude_usage("req_1", "msg_1", {"type": "text", "text": "first"}, (100, 600, 300, 600, 0, 50), m),
        L.claude_usage("req_1", "msg_1", {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "hi"}}, (100, 600, 300, 600, 0, 50), m),
        L.claude_usage("req_2", "msg_2", {"type": "text", "text": "second"}, (10, 0, 0, 0, 0, 5), m)])
    got = read_logs(spark, [f"{tmp_path}/.claude"], NOW, rates=rates(spark, (m, 1.0, 1.0, 1.0, 1.0, None, None, 0.0)))
    s = one(got.sessions)
    assert float(s.cost_usd) == 0.001065 and s.agent == "claude" and s.unmatched_tool_uses == 1


def test_claude_tier_and_alias(spark, tmp_path):
    L.write_lines(f"{tmp_path}/.claude/projects/p/a.jsonl", [L.claude_usage(
        "r", "m", {"type": "text", "text": "x"}, (100_000, 10_000, 120_000, 5_000, 5_000, 50_000), "claude-sonnet-4-6-20260219")])
    r = rates(spark, ("claude-sonnet-4.6", 3.0, 15.0, 0.3, 3.75, 3.75, 6.0, 0.0, 200_000, 6.0, 22.5, 0.6, 7.5, 7.5, 12.0))
    got = read_logs(spark, [f"{tmp_path}/.claude"], NOW, rates=r, windows=P.window_table(spark, (("claude-sonnet-4.6", 1_000_000),)))
    s = one(got.sessions)
    assert float(s.cost_usd) == 1.8945 and s.context_window_pct == pytest.approx(23)


def test_split_cache_and_tier_prices(spark):
    r = rates(spark, ("claude-sonnet-4.6", 3.0, 15.0, 0.3, 3.75, 3.75, 6.0, 0.0, 200_000, 6.0, 22.5, 0.6, 7.5, 7.5, 12.0),
              ("gpt-5.4", 1.25, 7.5, 0.125, 0.0, None, None, 0.0, 272_000, 2.5, 11.25))
    cols = "model string, prompt bigint, i bigint, r bigint, c bigint, m5 bigint, h1 bigint, o bigint"
    rows = [("claude-sonnet-4-6-20260219", 150_000, 100_000, 20_000, 10_000, 8_000, 2_000, 50_000),
            ("claude-sonnet-4-6-20260219", 250_000, 100_000, 20_000, 10_000, 8_000, 2_000, 50_000),
            ("gpt-5.4-2026-02-28", 200_000, 180_000, 20_000, 0, 0, 0, 40_000), ("gpt-5.4-2026-02-28", 300_000, 180_000, 20_000, 0, 0, 0, 40_000),
            ("nobody", 1, 1, 1, 1, 1, 1, 1)]
    c = F.col
    cost = P.usage_cost(c("prompt"), c("i"), c("r"), c("c"), c("m5"), c("h1"), c("o"), F.lit(0))
    got = P.with_rates(spark.createDataFrame(rows, cols), r).select("model", "prompt", cost.alias("cost")).orderBy("model", "prompt").collect()
    assert [None if g.cost is None else float(g.cost) for g in got] == [1.098, 1.821, 0.5275, 0.9025, None]


def test_document_session(spark, tmp_path):
    L.write_json(f"{tmp_path}/.gemini/tmp/x/chats/session-2026-02-17T01-07-50641617.json", L.DOCUMENT)
    r = rates(spark, ("gemini-3-flash-preview", 0.1, 0.4, 0.025, 0.0, None, None, 0.4))
    got = read_logs(spark, [f"{tmp_path}/.gemini"], NOW, rates=r, windows=P.window_table(spark, (("gemini-3-flash-preview", 1_000_000),)))
    s = one(got.sessions)
    assert (s.input_tokens, s.output_tokens, s.reasoning_output_tokens, s.total_tokens) == (24931, 79, 135, 25145)
    assert float(s.cost_usd) == 0.002579 and s.context_window_pct == pytest.approx(1.2727)
    kinds = [e.event_kind for e in got.events.orderBy("index").collect()]
    assert kinds == ["user", "reasoning", "tool_use", "tool_result", "reasoning", "assistant"]


def test_pi_kinds_and_embedded_cost(spark, tmp_path):
    msg = lambda role, content, **more: {"type": "message", "id": "m", "timestamp": "2026-02-11T10:00:01Z", "message": {
        "role": role, "content": content, **more}}
    usage = {"input": 10, "output": 5, "cacheRead": 0, "cacheWrite": 0, "totalTokens": 15, "cost": {"total": 0.25}}
    L.write_lines(f"{tmp_path}/.pi/agent/sessions/p/2026_abc.jsonl", [
        {"type": "session", "version": 3, "id": "pi-1", "timestamp": "2026-02-11T10:00:00Z", "cwd": "/w"},
        {"type": "model_change", "provider": "o", "modelId": "gpt-5.2"}, {"type": "thinking_level_change", "thinkingLevel": "high"},
        msg("user", [{"type": "text", "text": "hi"}]),
        msg("assistant", [{"type": "text", "text": "a"}, {"type": "thinking", "thinking": "t"},
                          {"type": "toolCall", "id": "c", "name": "bash", "arguments": {"c": 1}}], model="gpt-5.2", usage=usage),
        msg("toolResult", [{"type": "text", "text": "ok"}], toolCallId="c", toolName="bash"),
        msg("assistant", [{"type": "text", "text": "done"}], model="gpt-5.2")])
    got = read_logs(spark, [f"{tmp_path}/.pi"], NOW)
    kinds = [e.event_kind for e in got.events.orderBy("index").collect()]
    assert kinds == ["meta"] * 3 + ["user", "assistant", "reasoning", "tool_use", "tool_result", "assistant"]
    s = one(got.sessions)
    assert s.session_id == "pi-1" and float(s.cost_usd) == 0.25


def test_entity_session(spark, tmp_path):
    st = f"{tmp_path}/storage"
    L.write_json(f"{st}/session/p/ses_1.json", {"id": "ses_1", "slug": "x", "version": "1", "projectID": "p", "directory": "/w", "title": "T",
                                                "time": {"created": 1770804000000, "updated": 1770804100000}})
    L.write_json(f"{st}/message/ses_1/m1.json", {"id": "m1", "sessionID": "ses_1", "role": "user", "time": {"created": 1770804000001}})
    tokens = {"total": 0, "input": 5, "output": 2, "reasoning": 1, "cache": {"read": 1, "write": 0}}
    L.write_json(f"{st}/message/ses_1/m2.json", {"id": "m2", "sessionID": "ses_1", "role": "assistant", "modelID": "gpt-5.2", "tokens": tokens,
                                                 "time": {"created": 1770804000002, "completed": 1770804000009}})
    L.write_json(f"{st}/message/ses_1/m3.json", {"id": "m3", "sessionID": "other", "role": "user"})
    L.write_json(f"{st}/part/m1/p1.json", {"id": "p1", "sessionID": "ses_1", "type": "text", "text": "hi"})
    L.write_json(f"{st}/part/m2/p1.json", {"id": "p1", "type": "tool", "callID": "c1", "tool": "bash", "state": {
        "status": "error", "input": {"z": 1, "a": 2}, "error": "bad"}})
    got = read_entities(spark, str(tmp_path), NOW)
    ev = got.events.orderBy("index").collect()
    assert [e.event_kind for e in ev] == ["meta", "user", "tool_use", "tool_result"]
    assert ev[2].tool_args_text == '{"z":1,"a":2}' and ev[3].has_error and ev[3].ts_ms == 1770804000009
    s = one(got.sessions)
    assert s.total_tokens == 9 and s.session_id == "ses_1" and s.error_count == 1


def test_transcript_kinds(spark, tmp_path):
    text = ["user:", "<user_query>", "do it", "</user_query>", "", "assistant:", "[Thinking] plan", "[Tool call] Read", "  path: a.txt", "",
            "[Tool result] Read", "  content", "all done", "", "user:", "thanks"]
    L.write_lines(f"{tmp_path}/.cursor/projects/p/agent-transcripts/s1.txt", text)
    got = read_logs(spark, [f"{tmp_path}/.cursor"], NOW)
    ev = got.events.orderBy("index").collect()
    assert [e.event_kind for e in ev] == ["user", "reasoning", "tool_use", "tool_result", "assistant", "user"]
    assert ev[0].preview == "do it" and ev[2].tool_call_id == ev[3].tool_call_id == "cursor_tool_3" and ev[3].text_blocks == ["content"]
    assert len({e.ts_ms for e in ev}) == 6
    s = one(got.sessions)
    assert s.agent == "cursor" and s.input_tokens > 0 and s.output_tokens > 0


def test_first_and_last_follow_file_order(spark, tmp_path):
    rows = [{"session_id": "h", "ts": 1769000200, "text": "a"}, {"session_id": "h", "ts": "1769000100", "text": "b"}]
    L.write_lines(f"{tmp_path}/x.jsonl", rows)
    s = one(read_logs(spark, [str(tmp_path)], NOW).sessions)
    assert (s.first_ts_ms, s.last_ts_ms) == (1769000200000, 1769000100000)
    assert s.activity_bins_mode == "event_index" and len(s.activity_bins) == 12


def test_unreadable_file_is_a_row(spark, tmp_path):
    L.write_lines(f"{tmp_path}/bad.jsonl", ["not json", "[1]"])
    s = one(read_logs(spark, [str(tmp_path)], NOW).sessions)
    assert not s.parseable and s.parse_error and s.event_count == 0 and s.event_kind_counts["meta"] == 0


def test_idle_gap_day(spark):
    at = lambda h, m: 1_770_768_000_000 + (h * 60 + m) * 60_000  # 2026-02-11
    rows = [("t", i + 1, t, "tool_use") for i, t in enumerate([at(7, 5), at(7, 6), at(13, 0), at(13, 1)])]
    ev = spark.createDataFrame(rows, "trace_id string, index bigint, ts_ms bigint, event_kind string")
    ses = spark.createDataFrame([("t", "codex", at(7, 5), at(13, 1), at(13, 1))], "trace_id string, agent string, first_ts_ms bigint, last_ts_ms bigint, mtime_ms bigint")
    use = spark.createDataFrame([], "trace_id string, ts_ms bigint, output_tokens bigint, cost_usd decimal(18,6)")
    plan = day_plan("2026-02-11", now_ms=NOW)
    seg = active_segments(ev)
    assert [(s.start_ms, s.end_ms) for s in seg.orderBy("seg_no").collect()] == [(at(7, 5), at(7, 6)), (at(13, 0), at(13, 1))]
    bins = {b.start_ms: b for b in A.activity_bins(ev, seg, use, ses, plan).collect()}
    assert len(bins) == 288
    assert [bins[at(h, m)].active_sessions for h, m in ((7, 5), (7, 10), (10, 0), (13, 0))] == [1, 0, 0, 1]
    assert bins[at(10, 0)].is_break and not bins[at(7, 5)].is_break
    today = day_plan("2026-02-11", now_ms=at(8, 2))
    assert A.dense_bins(spark, today).agg(F.max("end_ms"), F.count("*")).first()[:] == (at(8, 2), 13)


def test_gap_is_strict(spark):
    g = 20 * 60_000
    ev = spark.createDataFrame([("a", 1), ("a", 1 + g), ("b", 1), ("b", 2 + g)], "trace_id string, ts_ms bigint")
    got = {r.trace_id: r.n for r in active_segments(ev).groupBy("trace_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 1, "b": 2}


def test_structured_wait_evaluates_its_row_once(spark):
    from sessionmill.functions import waits
    rows = spark.createDataFrame([('{"payload": {"status": "Awaiting_User"}}', None), ("{}", "waiting"), ("[", None), (None, "done"), ('{"status": "x"}', "y")], "j string, t string")
    found = rows.select(waits.structured_wait(F.try_parse_json("j"), F.col("t")).alias("w"))
    assert [r.w for r in found.collect()] == [True, True, False, False, False]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
