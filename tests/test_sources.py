"""Readers and discovery over written files: indented documents, hidden folders, deep content, side chains, profiles, scratch."""
import json
import os

from pyspark.sql import functions as F

from sessionmill.functions import variants as V
from sessionmill.operators import match as M
from sessionmill.operators.ordered import release, scratch_mark
from sessionmill.plans.ingest import Sources, listed_files, read_entities, read_logs
from sessionmill.sources import scan

from . import logs as L

NOW = 1_769_000_300_000


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_indented_documents_in_both_extensions(spark, tmp_path):
    tmp = f"{tmp_path}/.gemini/tmp/p/chats"
    write(f"{tmp}/session-a.json", json.dumps(L.DOCUMENT, indent=2))
    write(f"{tmp}/session-b.jsonl", json.dumps(L.DOCUMENT, indent=2).replace("50641617", "60641617"))
    lines = [json.dumps(m) for m in L.DOCUMENT["messages"]]
    write(f"{tmp}/session-c.json", "\n".join(lines))
    s = {os.path.basename(r.path): r for r in read_logs(spark, [str(tmp_path)], NOW).sessions.collect()}
    assert s["session-a.json"].event_count == s["session-b.jsonl"].event_count == s["session-c.json"].event_count > 3
    assert s["session-a.json"].session_id.startswith("50641617") and s["session-b.jsonl"].session_id.startswith("60641617")
    assert {r.parse_error for r in s.values()} == {""}
    d = scan.documents(spark, [str(tmp_path)]).select("path", scan.is_document(F.col("text")).alias("one")).collect()
    assert {os.path.basename(r.path): r.one for r in d} == {"session-a.json": True, "session-b.jsonl": True, "session-c.json": False}


def test_indented_entities_and_diff_placeholders(spark, tmp_path):
    at = f"{tmp_path}/storage"
    put = lambda path, value: write(f"{at}/{path}.json", json.dumps(value, indent=2))
    put("session/p/ses_1", {"id": "ses_1", "title": "One", "time": {"created": 1769000000000, "updated": 1769000001000}})
    put("session_diff/ses_1", [])
    put("session_diff/ses_2", {"id": "ses_2"})
    put("message/ses_1/msg_1", {"id": "msg_1", "sessionID": "ses_1", "role": "user", "time": {"created": 1769000000500}})
    put("part/msg_1/prt_1", {"id": "prt_1", "sessionID": "ses_1", "type": "text", "text": "hello"})
    assert scan.entities(spark, str(tmp_path), "part").count() == 1
    plain = read_entities(spark, str(tmp_path), NOW)
    assert plain.events.count() == 2 and plain.sessions.count() == 1
    with_diffs = {r.session_id: r.event_count for r in read_entities(spark, str(tmp_path), NOW, diffs=True).sessions.collect()}
    assert set(with_diffs) == {"ses_1", "ses_2"} and with_diffs["ses_1"] == 2


def test_hidden_folders_and_side_chains(spark, tmp_path):
    row = {"session_id": "h", "ts": 1769000200, "text": "a"}
    for path in ("a/_y/x.jsonl", "a/.z/_w/x.jsonl", "b/x.jsonl", "b/subagents/agent-acompact-1.jsonl", "_top/x.jsonl"):
        L.write_lines(f"{tmp_path}/{path}", [row])
    files = {r.path.removeprefix(f"{tmp_path}/") for r in listed_files(spark, [str(tmp_path)], "", None).collect()}
    assert files == {"a/_y/x.jsonl", "a/.z/_w/x.jsonl", "b/x.jsonl", "_top/x.jsonl"}
    assert scan.lines(spark, [str(tmp_path)]).count() == 5


def test_sources_choose_files_and_name_them(spark, tmp_path):
    row = {"session_id": "h", "ts": 1769000200, "text": "a"}
    L.write_lines(f"{tmp_path}/logs/x.jsonl", [row])
    L.write_lines(f"{tmp_path}/logs/skip/x.jsonl", [row])
    L.write_lines(f"{tmp_path}/.pi/agent/sessions/y.jsonl", [row])
    mine = Sources(profiles=(scan.Profile("mine", (f"{tmp_path}/logs",), include=("*.jsonl",)),), home=str(tmp_path))
    got = {os.path.basename(r.path): (r.source_profile, r.agent) for r in read_logs(spark, [str(tmp_path)], NOW, sources=mine).sessions.collect()}
    assert set(got) == {"x.jsonl", "y.jsonl"} and got["x.jsonl"][0] == "mine" and got["y.jsonl"] == ("session_log", "pi")


def test_content_nests_without_limit(spark):
    x = "deep"
    for n in range(12):
        x = [{"type": "tool_result", "content": x}]
    rows = spark.createDataFrame([(json.dumps({"c": x}),), (json.dumps({"c": [{"type": "text", "text": "flat [[[[[ text"}]}),)], "j string")
    got = rows.withColumn("v", F.try_parse_json("j")).select(V.text_blocks("v", "$.c").alias("b")).collect()
    assert sorted(r.b for r in got) == [["deep"], ["flat [[[[[ text"]]
    assert V.nested_blocks([{"content": {"b": 1, "a": 2}}, "x", {"text": "y"}, {"type": "text"}]) == ['{"b":1,"a":2}', "y"]


def test_launches_name_ids_of_any_form(spark):
    s = spark.createDataFrame([("t1", "u", "opencode", "ses_7fA"), ("t2", "u", "opencode", "ses_8")], "trace_id string, user string, agent string, session_id string")
    lc = spark.createDataFrame([(1, "u", "opencode --session SES_7fa"), (2, "u", "opencode /x/ses_8.json")], "pid long, user string, args string")
    assert {(r.trace_id, r.pid) for r in M.match_by_session_id(s, lc).collect()} == {("t1", 1), ("t2", 2)}


def test_scratch_folders_can_be_released(spark, tmp_path):
    L.write_lines(f"{tmp_path}/x.jsonl", [{"session_id": "h", "ts": 1769000200, "text": "a"}])
    before = scratch_mark(spark)
    assert read_logs(spark, [str(tmp_path)], NOW).sessions.count() == 1
    assert release(spark, before) > 0 and scratch_mark(spark) == before


def test_folders_are_listed_by_tasks_at_any_depth(spark, tmp_path):
    deep = tmp_path / "home"
    for i in range(20):
        deep = deep / (f".h{i}" if i % 2 else f"_h{i}")
    os.makedirs(deep / "plain")
    line = '{"type":"user","text":"x"}\n'
    for p in (deep / "plain/a.jsonl", deep / ".b.jsonl", deep / "_c.jsonl", tmp_path / "home/d.jsonl"):
        p.write_text(line * 2 + '{"type":"user"}\r\n{"type":"é"}')
    (deep / ".b.jsonl.crc").write_text("")
    (deep / ".x.crc").write_text("")
    os.makedirs(deep / "empty")
    os.symlink(tmp_path / "home", deep / "loop")
    root = str(tmp_path / "home")
    files = {r.path.rsplit("/", 1)[1]: r for r in scan.log_files(spark, [root]).collect()}
    assert set(files) == {"a.jsonl", ".b.jsonl", "_c.jsonl", "d.jsonl"} and files["d.jsonl"].size_bytes == os.path.getsize(tmp_path / "home/d.jsonl")
    assert files["d.jsonl"].mtime_ms == os.stat(tmp_path / "home/d.jsonl").st_mtime_ns // 1_000_000
    got = {}
    for r in scan.lines(spark, [root]).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row_no, r.offset, r.line, r.size_bytes))
    want = sorted(got["d.jsonl"])
    assert [w[2] for w in want] == [line.strip(), line.strip(), '{"type":"user"}', '{"type":"é"}'] and set(got) == set(files)
    assert all(sorted(g) == want for g in got.values())
    assert {r.path for r in scan.log_files(spark, [root], glob="*.jsonl").collect()} == {r.path for r in files.values()}
    assert scan.log_files(spark, [str(tmp_path / "none")]).count() == 0


def test_folders_that_cannot_be_read_are_told(spark, tmp_path, monkeypatch):
    from sessionmill.sources import trees
    (tmp_path / "a").mkdir()
    bad = str(tmp_path / "a" / "locked")
    rows = list(trees._listed(iter([__import__("pandas").DataFrame({"path": [str(tmp_path), str(tmp_path / "gone")]})])))
    assert [(r.path, r.folder, r.error) for b in rows for r in b.itertuples()] == [(str(tmp_path / "a"), True, None)]

    def denied(path):
        raise PermissionError(13, "Permission denied")
    monkeypatch.setattr(os, "lstat", denied)
    rows = list(trees._listed(iter([__import__("pandas").DataFrame({"path": [bad]})])))
    assert [(r.path, r.error) for b in rows for r in b.itertuples()] == [(bad, "PermissionError: Permission denied")]


def test_documents_in_pieces_give_the_rows_of_whole_ones(spark, tmp_path):
    import json
    put = lambda name, value, **kw: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value, **kw))
    put("a.json", {"sessionId": "s", "messages": [{"text": "é", "n": 1.5, "z": [1, {"b": 2}]}, 3, "x", {}]}, indent=2)
    put("b.json", {"messages": [{"b": 1, "a": 2}], "other": {"messages": [1]}, "session_id": "late"})
    put("c.json", [{"sessionId": "arr", "x": 1}, 5, {}, {"y": "q\\"}], indent=1)
    put("d.json", {"only": "object", "messages": []})
    put("e.json", '{"messages": [{"a": 1}')
    put("f.json", '{"type":"a"}\n{"type":"b"}\n')
    put("g.json", "[]")
    put(".h.json", {"messages": [{"text": "hidden"}]})
    columns = ["path", "doc_session_id", "row_no", "offset", "raw_json", "j"]
    rows = lambda large: sorted(map(tuple, scan.document_file_rows(spark, [str(tmp_path)], large=large).withColumn("j", F.to_json("v")).select(*columns).collect()))
    whole, pieces = rows(1 << 20), rows(0)
    assert whole == pieces and len(whole) == 9 and {r[1] for r in whole} == {"s", "late", "arr", ""}


def test_a_large_document_is_read_with_a_bounded_peak(tmp_path):
    import tracemalloc

    from sessionmill.sources import trees
    path = str(tmp_path / "big.json")
    with open(path, "w") as f:
        f.write('{"history": [')
        f.writelines(("," if i else "") + '{"t": "%s"}' % ("y" * 900) for i in range(20_000))
        f.write('], "messages": [')
        f.writelines(("," if i else "") + '{"t": "%s"}' % ("x" * 900) for i in range(20_000))
        f.write('], "sessionId": "big"}')
    tracemalloc.start()
    assert trees.outline(trees._chunks(path)) == ("messages", "big")
    assert sum(1 for _ in trees.messages_of("messages", trees._chunks(path))) == 20_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < os.path.getsize(path) / 3


def test_small_files_are_opened_by_tasks_and_give_the_rows_of_sparks_reader(spark, tmp_path, monkeypatch):
    odd = {"a.jsonl": b"\xef\xbb\xbf{\"a\": 1}\r\nb\r\r\n\nz\r\xe2\x80\xa8", "b c+%20.json": b"\xff\xc3\xa9\xe2\x82x\r\nlast", "empty.json": b"", "_h.json": b"{}\n", "d/.e.jsonl": b"{}", "end.json": "ü\n\n".encode()}
    for name, data in odd.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert not any("jsonl" in n for n in scan.lines(spark, [str(tmp_path)]).inputFiles())
    with __import__("gzip").open(tmp_path / "p.json.gz", "wb") as f:
        f.write(b"packed\n")
    raw = lambda df, c: sorted((r[:-1], bytes(r[-1])) for r in df.withColumn(c, F.col(c).cast("binary")).select(*[x for x in df.columns if x != c], c).collect())
    near = raw(scan.lines(spark, [str(tmp_path)]), "line"), raw(scan.documents(spark, [str(tmp_path)], glob="*.json*"), "text")
    monkeypatch.setattr(scan.trees, "SMALL", -1)
    assert near == (raw(scan.lines(spark, [str(tmp_path)]), "line"), raw(scan.documents(spark, [str(tmp_path)], glob="*.json*"), "text"))
    assert len(near[1]) == 4 and (b"packed",) in {r[-1:] for r in near[0]}


def test_files_are_written_by_many_tasks(spark, tmp_path):
    spark.sparkContext.setJobGroup("written", "")
    rows = spark.range(100).coalesce(1).select(F.concat(F.lit("f/"), "id", F.lit(".json")).alias("name"), F.lit("{}").alias("text"))
    scan.write_files(rows, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("written") for s in status.getJobInfo(j).stageIds]
    assert max(tasks) >= spark.sparkContext.defaultParallelism and len(os.listdir(tmp_path / "f")) == 100
