"""Registered queries over usage rows of each log format, over files written from the tables, and of single functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, times
from ..functions import variants as V
from ..operators import browse as B
from ..operators import sessions as S
from ..operators import usage_rows as U
from ..operators.ordered import running, scratch_dir
from ..sources import scan
from ..sources.formats import opencode
from . import datasets as D
from .oracle import EVENTS, SESS, q
from .registry import query

_S, _C = F.struct, F.col
_OUT = ("trace_id", "row_no", "model", "input_tokens", "cached_read_tokens", "cached_create_tokens", "output_tokens", "reasoning_output_tokens",
        "total_tokens", "prompt_tokens", "billable_input")


def _n(expr: str, name: str):
    return F.expr(expr).cast("bigint").alias(name)


def _rows(spark, sf, raw):
    """Log rows made of events: the JSON text of each, parsed."""
    e = D.events(spark, sf)
    return e.select("trace_id", _C("index").alias("row_no"), "ts_ms", F.try_parse_json(raw).alias("v"))


_CLAUDE = """u AS (SELECT trace_id, seq AS row_no, CASE WHEN k % 3 > 0 THEN 'request:r' || k % 40 WHEN k % 5 > 0 THEN 'message:m' || k % 30 ELSE '' END AS key,
  input_tokens AS i, k AS r, greatest(k % 5, k % 3 + k % 4) AS c, output_tokens AS o, k % 3 AS m5, k % 4 AS h1 FROM ev WHERE raw_type <> 'error')"""


@query(q("""SELECT trace_id, row_no, 'claude-x' AS model, i AS input_tokens, r AS cached_read_tokens, c AS cached_create_tokens, o AS output_tokens,
  0::BIGINT AS reasoning_output_tokens, i + r + c + o AS total_tokens, i + r + c AS prompt_tokens, i AS billable_input, m5 AS create_5m, h1 AS create_1h
  FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, key ORDER BY row_no) AS rn FROM u) WHERE rn = 1 OR key = ''""", EVENTS, _CLAUDE))
def claude_usage(spark, sf):
    usage = _S(_n("input_tokens", "input_tokens"), _n("k", "cache_read_input_tokens"), _n("k % 5", "cache_creation_input_tokens"), _n("output_tokens", "output_tokens"),
               _S(_n("k % 3", "ephemeral_5m_input_tokens"), _n("k % 4", "ephemeral_1h_input_tokens")).alias("cache_creation")).alias("usage")
    raw = F.to_json(_S(F.expr("if(raw_type = 'error', 'user', 'Assistant')").alias("type"), F.expr("if(k % 3 > 0, concat('r', k % 40), ' ')").alias("requestId"),
                       _S(F.expr("if(k % 5 > 0, concat('m', k % 30), '')").alias("id"), F.lit("claude-x").alias("model"), usage).alias("message")))
    return U.claude_usage(_rows(spark, sf, raw)).select(*_OUT, "create_5m", "create_1h")


def _codex_rows(spark, sf):
    total = _S(_n("index * 10", "input_tokens"), _n("index * 2", "cached_input_tokens"), _n("index * 3", "output_tokens"), _n("0", "reasoning_output_tokens"), _n("index * 13", "total_tokens"))
    last = _S(_n("k", "input_tokens"), _n("k % 7", "cached_input_tokens"), _n("k % 5", "output_tokens"), _n("0", "reasoning_output_tokens"), _n("k + k % 5", "total_tokens"))
    count = _S(F.lit("event_msg").alias("type"), _S(F.lit("token_count").alias("type"), _S(
        total.alias("total_token_usage"), F.when(_C("k") % 2 == 0, last).alias("last_token_usage")).alias("info")).alias("payload"))
    context = _S(F.lit("turn_context").alias("type"), _S(F.concat(F.lit("gpt-"), _C("k") % 3).alias("model")).alias("payload"))
    return _rows(spark, sf, F.when(_C("raw_type") == "signup", F.to_json(context)).otherwise(F.to_json(count)))


_CODEX = """c0 AS (SELECT trace_id, seq, raw_type, last_value(CASE WHEN raw_type = 'signup' THEN 'gpt-' || k % 3 END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq) AS m,
   seq * 13 AS cum, k % 2 = 0 AS own, CASE WHEN k % 2 = 0 THEN k ELSE seq * 10 END AS i, CASE WHEN k % 2 = 0 THEN k % 7 ELSE seq * 2 END AS r,
   CASE WHEN k % 2 = 0 THEN k % 5 ELSE seq * 3 END AS o, CASE WHEN k % 2 = 0 THEN k + k % 5 ELSE seq * 13 END AS t FROM ev),
 c1 AS (SELECT *, r > 0 AND t > 0 AND i + r + o > t AS incl, cum - coalesce(lag(cum) OVER (PARTITION BY trace_id ORDER BY seq), 0) AS delta FROM c0 WHERE raw_type <> 'signup')"""


@query(q("""SELECT trace_id, seq AS row_no, coalesce(m, '<unknown>') AS model, i AS input_tokens, r AS cached_read_tokens, 0::BIGINT AS cached_create_tokens, o AS output_tokens,
  0::BIGINT AS reasoning_output_tokens, CASE WHEN t > 0 THEN t ELSE i + r + o END AS total_tokens, CASE WHEN incl AND i > 0 THEN i WHEN NOT incl AND i + r > 0 THEN i + r ELSE t END
  AS prompt_tokens, CASE WHEN incl THEN greatest(i - r, 0) ELSE i END AS billable_input, greatest(delta, 0) AS model_delta FROM c1""", EVENTS, _CODEX))
def codex_usage(spark, sf):
    return U.codex_usage(_codex_rows(spark, sf)).select(*_OUT, "model_delta")


@query(q("""SELECT trace_id, max(seq) * 10 AS input_tokens, max(seq) * 2 AS cached_read_tokens, max(seq) * 3 AS output_tokens,
  CASE WHEN max(seq) > 0 THEN max(seq) * 13 ELSE 0 END AS total_tokens FROM ev WHERE raw_type <> 'signup' GROUP BY trace_id""", EVENTS))
def cumulative_totals(spark, sf):
    return U.codex_totals(_codex_rows(spark, sf)).select("trace_id", "input_tokens", "cached_read_tokens", "output_tokens", "total_tokens")


_FIRST = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, k % 50 ORDER BY seq) AS rn FROM ev WHERE raw_type <> 'signup') WHERE rn = 1 AND k % 4 > 0)"""


@query(q("""SELECT trace_id, seq AS row_no, CASE WHEN k % 3 = 0 THEN 'prov/<unknown>' ELSE 'mod' END AS model, input_tokens, k AS cached_read_tokens, k % 5 AS cached_create_tokens,
  output_tokens, k % 7 AS reasoning_output_tokens, input_tokens + k + k % 5 + output_tokens + k % 7 AS total_tokens, input_tokens + k + k % 5 AS prompt_tokens,
  input_tokens AS billable_input FROM f""", EVENTS, _FIRST))
def opencode_usage(spark, sf):
    tokens = _S(_n("input_tokens", "input"), _n("output_tokens", "output"), _n("k % 7", "reasoning"), _S(_n("k", "read"), _n("k % 5", "write")).alias("cache"))
    raw = F.to_json(_S(F.expr("if(raw_type = 'signup', 'user', 'assistant')").alias("role"), F.concat(F.lit("m"), _C("k") % 50).alias("id"), F.lit("prov").alias("providerID"),
                       F.expr("if(k % 3 = 0, null, 'mod')").alias("modelID"), F.when(_C("k") % 4 > 0, tokens).alias("tokens")))
    return U.opencode_usage(_rows(spark, sf, raw)).select(*_OUT)


@query(q("""SELECT trace_id, seq AS row_no, CASE WHEN k % 3 = 0 THEN 'ver' ELSE 'mod' END AS model, input_tokens, k AS cached_read_tokens, 0::BIGINT AS cached_create_tokens,
  output_tokens + k % 5 AS output_tokens, k % 7 AS reasoning_output_tokens, CASE WHEN k % 11 > 0 THEN k % 11 ELSE input_tokens + k + output_tokens + k % 5 + k % 7 END AS total_tokens,
  input_tokens + k AS prompt_tokens, input_tokens AS billable_input FROM f""", EVENTS, _FIRST))
def gemini_usage(spark, sf):
    tokens = _S(_n("input_tokens", "input"), _n("k", "cached"), _n("output_tokens", "output"), _n("k % 5", "tool"), _n("k % 7", "thoughts"), _n("k % 11", "total"))
    raw = F.to_json(_S(F.expr("if(raw_type = 'signup', 'user', 'Gemini')").alias("type"), F.concat(F.lit("m"), _C("k") % 50).alias("id"), F.lit("ver").alias("modelVersion"),
                       F.expr("if(k % 3 = 0, null, 'mod')").alias("model"), F.when(_C("k") % 4 > 0, tokens).alias("tokens")))
    return U.gemini_usage(_rows(spark, sf, raw)).select(*_OUT)


@query(q("""SELECT trace_id, seq AS row_no, CASE WHEN k % 3 = 0 THEN '<unknown>' ELSE 'mod' END AS model, input_tokens, k AS cached_read_tokens, k % 5 AS cached_create_tokens,
  output_tokens, k % 7 AS reasoning_output_tokens, CASE WHEN k % 11 > 0 THEN k % 11 ELSE input_tokens + k + k % 5 + output_tokens + k % 7 END AS total_tokens,
  input_tokens + k + k % 5 AS prompt_tokens, input_tokens AS billable_input, CAST(k / 1000 AS DOUBLE) AS embedded_cost FROM ev WHERE raw_type <> 'signup'""", EVENTS))
def pi_usage(spark, sf):
    usage = _S(_n("input_tokens", "input"), _n("k", "cacheRead"), _n("k % 5", "cacheWrite"), _n("output_tokens", "output"), _n("k % 7", "reasoning"), _n("k % 11", "totalTokens"),
               _S((_C("k") / 1000).cast("decimal(18,3)").alias("total")).alias("cost"))
    raw = F.to_json(_S(F.lit("message").alias("type"), _S(F.expr("if(raw_type = 'signup', 'user', 'assistant')").alias("role"), F.expr("if(k % 3 = 0, null, 'mod')").alias("modelId"),
                                                          usage.alias("usage")).alias("message")))
    return U.pi_usage(_rows(spark, sf, raw)).select(*_OUT, _C("embedded_cost").cast("double").alias("embedded_cost"))


# ---- sessions and events ------------------------------------------------------------------------------------------


@query(q("""SELECT trace_id, event_count, error_count, tool_use_count, tool_result_count, first_ts_ms, last_ts_ms, greatest(last_ts_ms, mtime_ms) AS updated_ms, true AS parseable
  FROM sess UNION ALL SELECT 'none' || trace_id, 0, 0, 0, 0, NULL, NULL, 5, false FROM sess WHERE CAST(trace_id AS BIGINT) % 7 = 0""", EVENTS, SESS))
def session_summary(spark, sf):
    """Every seventh session has a second file without events."""
    e = D.events(spark, sf).withColumns({"raw_json": F.lit("{}"), "v": F.parse_json(F.lit("{}")), "text_blocks": F.array("preview"), "search_text": F.lower("preview"),
                                          "tool_args_text": F.lit(""), "tool_result_text": F.lit("")})
    s = D.sessions(spark, sf).select("trace_id", "path", F.lit("").alias("source_profile"), "agent", F.lit("x").alias("parser"), "session_id",
                                     F.lit(1).cast("bigint").alias("size_bytes"), "mtime_ms", F.lit("").alias("parse_error"))
    none = s.filter(_C("trace_id").cast("bigint") % 7 == 0).withColumns({"trace_id": F.concat(F.lit("none"), "trace_id"), "mtime_ms": F.lit(5).cast("bigint"), "parse_error": F.lit("no parseable rows")})
    return S.summarize(e, s.unionByName(none), D.NOW_MS).select("trace_id", "event_count", "error_count", "tool_use_count", "tool_result_count", "first_ts_ms", "last_ts_ms",
                                                                "updated_ms", "parseable")


@query(q("SELECT event_id, event_kind FROM ev WHERE event_kind <> 'meta'", EVENTS))
def events_without_meta(spark, sf):
    return B.without_meta(D.events(spark, sf)).select("event_id", "event_kind")


@query(q("SELECT event_id, preview FROM ev WHERE contains(lower(preview), 'error 1')", EVENTS))
def search_events(spark, sf):
    e = D.events(spark, sf).withColumn("search_text", F.lower("preview"))
    return B.search_events(e, " ERROR 1").select("event_id", "preview")


@query(q("SELECT event_id, ts_ms FROM ev", EVENTS))
def timeline(spark, sf):
    """All events, latest first."""
    return B.timeline(D.events(spark, sf), descending=True).select("event_id", "ts_ms")


@query(q("SELECT event_id, ts_ms, row_number() OVER (PARTITION BY trace_id ORDER BY ts_ms DESC, seq DESC) AS place FROM ev", EVENTS))
def timeline_places(spark, sf):
    """Every event's place in its session, latest first; a session is ordered in chunks of an hour."""
    e = D.events(spark, sf).select("trace_id", "event_id", "ts_ms", (-_C("ts_ms")).alias("back"), (-_C("index")).alias("tie"))
    placed = running(e, ["trace_id"], "back", {"place": ("count", None)}, tie=["tie"], chunk=F.floor(_C("back") / 3_600_000).cast("bigint"))
    return placed.select("event_id", "ts_ms", "place")


# ---- functions ----------------------------------------------------------------------------------------------------


@query(q(r"""SELECT event_id, left(sha1(encode(event_id) || '\x00'::BLOB || encode(CAST(k AS VARCHAR)) || '\x00'::BLOB), 24) AS stable_id FROM ev""", EVENTS))
def stable_ids(spark, sf):
    return D.events(spark, sf).select("event_id", ids.stable_id(_C("event_id"), _C("k").cast("string")).alias("stable_id"))


@query(q("""SELECT event_id, CASE k % 4 WHEN 0 THEN ts_ms WHEN 1 THEN ts_ms + 1000 WHEN 2 THEN ts_ms + 2000 ELSE 0 END AS anchor_ms FROM ev""", EVENTS))
def document_anchor(spark, sf):
    at = lambda plus: F.date_format(F.timestamp_millis(_C("ts_ms") + plus), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    k = _C("k") % 4
    raw = F.to_json(_S(F.when(k == 0, at(0)).when(k == 1, "never").alias("startTime"), F.when(k < 2, F.array(_S(at(1000).alias("timestamp")))).alias("messages"),
                       F.when(k <= 2, at(2000)).alias("lastUpdated")))
    return D.events(spark, sf).select("event_id", times.document_anchor_ms(F.try_parse_json(raw)).alias("anchor_ms"))


_HEX = "lpad(to_hex(k), 8, '0') || '-0000-0000-0000-' || lpad(to_hex(seq), 12, '0')"


@query(q(f"""SELECT event_id, CASE WHEN k % 2 = 0 THEN lower({_HEX}) ELSE '' END AS in_paths, k % 3 = 0 AS listed, k % 3 < 2 AS mentioned FROM ev""", EVENTS))
def session_mentions(spark, sf):
    e = D.events(spark, sf)
    uid = F.concat(F.lpad(F.hex("k"), 8, "0"), F.lit("-0000-0000-0000-"), F.lpad(F.hex("index"), 12, "0"))
    store = F.concat(F.lit("/h/.cursor/chats/x/"), uid, F.expr("if(k % 2 = 0, '/store.db-wal', '/other')"))
    sid, k3 = F.concat(F.lit("S"), "index"), _C("k") % 3
    other = F.concat(F.lit("s"), "index", F.lit("x"))
    array_log = F.to_json(F.array(_S(F.when(k3 == 0, sid).otherwise(other).alias("sessionId"))))
    text_log = F.concat(F.lit("log of "), F.when(k3 < 2, F.lower(sid)).otherwise("nobody"))
    return e.select("event_id", F.array_join(ids.session_ids_in_paths(F.array(store, store)), ",").alias("in_paths"),
                    ids.log_mentions_session(array_log, sid).alias("listed"), ids.log_mentions_session(text_log, sid).alias("mentioned"))


# ---- files written from the tables --------------------------------------------------------------------------------


@query(q("""SELECT trace_id, row_no, 'x' || k AS text FROM (SELECT trace_id, k, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS row_no FROM ev)""", EVENTS))
def document_files(spark, sf):
    """Every session as indented documents on disk, their messages numbered on through its documents."""
    return document_part_files(spark, sf).select("trace_id", (_C("part") * _MESSAGES + _C("row_no")).alias("row_no"), "text")


_MESSAGES = 500   # messages of a document


@query(q(f"""SELECT trace_id, n // {_MESSAGES} AS part, n % {_MESSAGES} AS row_no, 'x' || k AS text
  FROM (SELECT trace_id, k, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS n FROM ev)""", EVENTS))
def document_part_files(spark, sf):
    """All events, at most ``_MESSAGES`` of a session in one indented document, read as a whole file."""
    e = running(D.events(spark, sf).select("trace_id", "index", "k"), ["trace_id"], "index", {"n": ("count", None)}).withColumn("n", _C("n") - 1)
    part = F.floor(_C("n") / _MESSAGES).cast("bigint")
    docs = e.groupBy("trace_id", part.alias("part")).agg(F.sort_array(F.collect_list(_S("n", "k"))).alias("a"))
    body = F.to_json(_S(F.lit("d").alias("sessionId"), F.transform("a", lambda x: _S(F.concat(F.lit("x"), x["k"]).alias("text"))).alias("messages")), {"pretty": "true"})
    path = scratch_dir(spark)
    name = F.concat(F.lit("owner="), F.concat_ws("-", "trace_id", "part"), F.lit("/document.txt"))
    scan.write_files(docs.select(name.alias("name"), body.alias("text")), path)
    rows = scan.document_rows(scan.documents(spark, [path]))
    owner = lambda i: F.regexp_extract("path", "owner=([^/]+)-([0-9]+)/", i)
    return rows.select(owner(1).alias("trace_id"), owner(2).cast("bigint").alias("part"), "row_no", V.text(_C("v"), "$.text").alias("text"))


@query("""SELECT 's' || conv_id AS owner, 'one' || turn AS text FROM conversations""")
def entity_files(spark, sf):
    """Message files of all conversations, each written by its name in tasks, read back with their folder as owner."""
    t, root = D.table(spark, sf, "conversations").withColumn("__n", F.monotonically_increasing_id()), scratch_dir(spark)
    body = F.to_json(_S(F.concat(F.lit("one"), "turn").alias("text")), {"pretty": "true"})
    name = F.concat(F.lit("storage/message/s"), "conv_id", F.lit("/"), "__n", F.lit(".json"))
    scan.write_files(t.select(name.alias("name"), body.alias("text")), root)
    return scan.entities(spark, root, "message").select("owner", V.text(_C("v"), "$.text").alias("text"))


@query("""SELECT 's' || conv_id AS owner, 'one' || turn AS text FROM conversations""")
def entity_message_files(spark, sf):
    """Message files of all conversations, indented, read back with their folder as owner."""
    t, root = D.table(spark, sf, "conversations").withColumn("__n", F.monotonically_increasing_id()), scratch_dir(spark)
    body = F.to_json(_S(F.concat(F.lit("one"), "turn").alias("text")), {"pretty": "true"})
    owner = F.coalesce(F.concat(F.lit("s"), "conv_id"), F.lit("__HIVE_DEFAULT_PARTITION__"))   # the folder that Spark gives rows without one
    name = F.concat(F.lit("storage/message/owner="), owner, F.lit("/"), "__n", F.lit(".txt"))
    scan.write_files(t.select(name.alias("name"), body.alias("text")), root)
    found = scan.entities(spark, root, "message", glob="*")
    return found.select(F.regexp_replace("owner", "^owner=", "").alias("owner"), V.text(_C("v"), "$.text").alias("text"))
