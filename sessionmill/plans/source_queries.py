"""Queries on scanning, format jobs, entity joins and column functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, times, tools, waits
from ..functions import text as X
from ..functions import variants as V
from ..operators import sets as T
from ..operators import usage_rows as U
from ..operators.ordered import running, scratch_dir
from ..sources import scan
from ..sources.formats import claude, codex, cursor, gemini, generic, opencode, pi
from ..sources.formats.common import inherit_tool_type
from ..sources.formats.registry import FormatRegistry
from . import datasets as D
from .oracle import EVENTS, SESS, TURNS, q
from .registry import query

# ---- column functions over documents and events -------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN length(f) <= 140 THEN f ELSE f[:139] || '…' END AS preview,
  CASE WHEN length(o) <= 220 THEN o ELSE o[:219] || '…' END AS compact FROM (SELECT doc_id,
  regexp_extract(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^([^\\r\\n]*)', 1) AS f,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) AS o FROM documents)""")
def preview_compact(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"),
                                                  X.compact(F.col("text")).alias("compact"))


@query("""SELECT doc_id, CASE WHEN length(text) > 50 THEN text[:50] ELSE text END AS text, length(text) > 50 AS truncated
  FROM documents""")
def truncate_text(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.truncated(F.col("text"), 50).alias("t")).select("doc_id", "t.*")


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS inline_text, trim(regexp_extract('<q> ' || lang || ' </q>',
  '<q>\\s*(.*?)\\s*</q>', 1)) AS tagged, source || '-' || doc_id AS call_id, doc_id || '.jsonl' AS tail,
  'tokens: total=' || (n_chars + 10 + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END) || ' input=' || n_chars ||
  ' output=10 reasoning=' || CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END || ' cache_read=0 cache_write=0' AS summary FROM documents""")
def scalar_text(spark, sf):
    d, z = D.table(spark, sf, "documents"), F.lit(0.0)
    r = F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(0.0)
    return d.select(
        "doc_id", X.inline(F.col("text")).alias("inline_text"),
        X.tagged(F.concat(F.lit("a <Q> "), "lang", F.lit(" </q> b")), "q").alias("tagged"),
        X.call_id_in(F.concat(F.lit("x Call-ID: "), "source", F.lit("-"), "doc_id", F.lit(" y"))).alias("call_id"),
        X.path_tail(F.concat(F.lit("/a/b\\c/"), "doc_id", F.lit(".jsonl"))).alias("tail"),
        X.token_summary(F.col("n_chars").cast("double"), F.lit(10.0), r, z, z, F.lit(None).cast("double")).alias("summary"))


@query(q("""SELECT event_id, ts_ms AS from_ms, ts_ms // 1000 * 1000 AS from_s, ts_ms AS from_text, CASE seq % 4 WHEN 3 THEN NULL ELSE ts_ms END AS guessed,
  strftime(make_timestamp((ts_ms - 7200000) * 1000), '%Y-%m-%d') AS local_date, k * 3600000 AS duration, CAST(least(greatest(
  floor((ts_ms - 1704067200000) / 300000), 0), 99) AS INTEGER) AS bin FROM ev""", EVENTS))
def scalar_time(spark, sf):
    e, ts = D.events(spark, sf), F.col("ts_ms")
    iso = F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    i = F.col("index") % 4
    raw = (F.when(i == 0, F.to_json(F.struct(iso.alias("timestamp")))).when(i == 1, F.to_json(F.struct(F.struct(ts.alias("updatedAt")).alias("payload"))))
           .when(i == 2, F.to_json(F.struct(F.lit("soon").alias("date"), F.struct(iso.alias("created_at")).alias("message")))).otherwise('{"ts":7}'))
    e = e.withColumn("v", F.try_parse_json(raw))
    return e.select("event_id", times.epoch_ms(ts.cast("string")).alias("from_ms"),
                    times.epoch_ms(F.floor(ts / 1000).cast("string")).alias("from_s"), times.epoch_ms(iso).alias("from_text"),
                    times.guess_ts("v").alias("guessed"), times.local_date(ts, 120).alias("local_date"),
                    times.duration_ms(F.concat(F.lit(" "), "k", F.lit("H"))).alias("duration"),
                    times.bin_index(ts, F.lit(1_704_067_200_000), 300_000, 100).alias("bin"))


@query(q("""SELECT event_id, 'f' || k || '.x' AS plain, 'f' || k AS document,
  't' || k AS suffix, 'gpt-5.4' AS m1, 'claude-opus-4.' || CASE WHEN k % 2 = 0 THEN 5 ELSE 6 END AS m2, 'x-' || k AS m3 FROM ev""", EVENTS))
def scalar_ids(spark, sf):
    e, k = D.events(spark, sf), F.col("k").cast("string")
    path = lambda *x: F.concat(F.lit("/a.b/"), *x)
    return e.select("event_id", ids.session_id_plain(path(F.lit("f"), k, F.lit(".x.jsonl"))).alias("plain"),
                    ids.session_id_document(path(F.lit("session-f"), k, F.lit(".json"))).alias("document"),
                    ids.session_id_suffix(path(F.lit("2024_x_t"), k, F.lit(".jsonl"))).alias("suffix"),
                    ids.pricing_model(F.lit(" OpenAI/gpt-5.4-2026-03-05 ")).alias("m1"),
                    ids.pricing_model(F.concat(F.lit("global.anthropic.claude-opus-4-"), F.when(F.col("k") % 2 == 0, "5").otherwise("6"),
                                               F.lit("-20250101-v1:0"))).alias("m2"),
                    ids.pricing_model(F.concat(F.lit("x-"), k)).alias("m3"))


@query(q("""SELECT event_id, CASE k % 4 WHEN 0 THEN 'bash' WHEN 1 THEN 'patch' WHEN 2 THEN 'my_tool' ELSE 'websearch' END AS claude,
  CASE k % 4 WHEN 0 THEN 'exec-command' WHEN 1 THEN 'apply patch' WHEN 2 THEN 'my tool' ELSE 'web_search' END AS codex,
  CASE k % 4 WHEN 0 THEN 'bash' WHEN 1 THEN 'edit' WHEN 2 THEN 'my_tool' ELSE 'search' END AS cursor,
  CASE k % 4 WHEN 0 THEN 'bash' WHEN 1 THEN 'patch' WHEN 2 THEN 'my_tool' ELSE 'web:search' END AS opencode,
  CASE k % 4 WHEN 0 THEN 'bash' WHEN 1 THEN 'patch' WHEN 2 THEN 'my_tool' ELSE 'websearch' END AS gemini,
  CASE k % 4 WHEN 0 THEN 'bash' WHEN 1 THEN 'patch' WHEN 2 THEN 'my_tool' ELSE 'websearch' END AS pi,
  CASE k % 4 WHEN 0 THEN 'web:search' WHEN 1 THEN 'web:open' ELSE 'web' END AS web, k % 4 = 1 AS err,
  CASE k % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'user' ELSE 'assistant' END AS role_kind,
  CASE k % 4 WHEN 0 THEN 'Summary: s' || k ELSE 'plain ' || k END AS reasoning FROM ev""", EVENTS))
def scalar_tools(spark, sf):
    e, m = D.events(spark, sf), F.col("k") % 4
    name = F.when(m == 0, "Exec-Command").when(m == 1, "apply patch").when(m == 2, " My Tool").otherwise("web_search")
    raw = F.when(m == 0, F.to_json(F.struct(F.array(F.struct(F.lit("summary_text").alias("type"), F.concat(F.lit(" s"), "k").alias("text"))).alias("a")))) \
        .otherwise(F.to_json(F.struct(F.concat(F.lit("plain  "), "k").alias("a"))))
    e = e.withColumn("v", F.try_parse_json(raw))
    return e.select("event_id", *[tools.tool_type(name, d).alias(d) for d in ("claude", "codex", "cursor", "opencode", "gemini", "pi")],
                    tools.web_tool_type(F.when(m == 0, "search").when(m == 1, "Open_Page").otherwise("zap")).alias("web"),
                    tools.status_is_error(F.when(m == 1, "Failed").otherwise("ok")).alias("err"),
                    tools.kind_of_role(F.when(m == 0, "Developer").when(m == 1, " user").otherwise("x")).alias("role_kind"),
                    tools.reasoning_text("v", raw, "$.b", "$.a").alias("reasoning"))


@query(q("""SELECT event_id, k % 5 IN (0, 1, 2) AS structured, k % 3 = 0 AS by_text, CASE k % 3 WHEN 0 THEN 'a' WHEN 1 THEN '1' ELSE '' END AS picked,
  CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS blocks FROM ev""", EVENTS))
def scalar_markers(spark, sf):
    e, m, t = D.events(spark, sf), F.col("k") % 5, F.col("k") % 3
    status = F.when(m == 0, "awaiting_user_input").when(m == 1, "Permission-Required").when(m == 2, "waiting").otherwise("done")
    v = F.try_parse_json(F.to_json(F.struct(F.struct(status.alias("status")).alias("payload"))))
    text = F.when(t == 0, "Should I go on?").otherwise("I went on")
    w = F.try_parse_json(F.when(t == 0, '{"a":"a","c":[{"type":"text","text":"x"}]}').when(t == 1, '{"a":0,"b":1,"c":[{"type":"tool_result","content":[{"text":"p"},{"output":"q"}]}]}')
                         .otherwise('{"a":null,"b":"","c":{"x":1}}'))
    e, wc = e.withColumn("w", w), F.col("w")
    return e.select("event_id", waits.structured_wait(v, F.col("raw_type")).alias("structured"), waits.text_wait(text).alias("by_text"),
                    V.first_text(wc, "$.a", "$.b").alias("picked"), F.size(V.text_blocks("w", "$.c")).alias("blocks"))


# ---- carried and interpolated values --------------------------------------------------------------------------------


@query(q("""SELECT trace_id, index, CASE WHEN n = 1 OR s = e THEN s + index - 1 ELSE s + CAST(floor((e - s) * (index - 1) / greatest(n - 1, 1) + 0.5)
  AS BIGINT) END AS ts_ms FROM (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY index) AS index, count(*) OVER
  (PARTITION BY trace_id) AS n, 1700000000000 + CAST(trace_id AS BIGINT) * 1000 AS s, 1700000000000 + CAST(trace_id AS BIGINT) * 1000
  + CAST(trace_id AS BIGINT) % 3 * 60001 AS e FROM tu)""".replace("n = 1 OR s = e", "s = e"), TURNS))
def interpolate_ts(spark, sf):
    from ..operators.ordered import attach_by_chunk, dense_index
    t = dense_index(D.turns(spark, sf).withColumnRenamed("index", "seq"), ["trace_id"], "seq")
    n = t.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    u = F.col("trace_id").cast("bigint")
    start = F.lit(1_700_000_000_000) + u * 1000
    df = attach_by_chunk(t, n, "trace_id", "index", "n")
    return df.select("trace_id", "index", cursor.interpolated_ts(start, start + u % 3 * 60_001, F.col("index"), F.col("n")).alias("ts_ms"))


@query(q("""SELECT event_id, coalesce(first_value(sid IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED
  PRECEDING AND CURRENT ROW), 'file-' || trace_id) AS session_id FROM (SELECT *, CASE WHEN k % 6 = 0 THEN 'n' || k END AS sid FROM ev)""", EVENTS))
def session_id_fill(spark, sf):
    e = D.events(spark, sf)
    sid = F.when(F.col("k") % 6 == 0, F.concat(F.lit("n"), "k"))
    out = running(e, ["trace_id"], "index", {"sid": ("first", sid)})
    return out.select("event_id", F.coalesce("sid", F.concat(F.lit("file-"), "trace_id")).alias("session_id"))


_INHERIT = """inh AS (SELECT event_id, event_kind, last_value(CASE WHEN event_kind = 'tool_use' THEN tool_type END IGNORE NULLS) OVER
  (PARTITION BY trace_id, tool_use_id ORDER BY seq) AS seen FROM ev WHERE tool_use_id <> '')"""


@query(q("SELECT event_id, coalesce(seen, '') AS tool_type FROM inh WHERE event_kind = 'tool_result'", EVENTS, _INHERIT))
def tool_type_inherit(spark, sf):
    e = D.events(spark, sf).withColumn("tool_type", F.when(F.col("event_kind") == "tool_use", F.col("tool_type")).otherwise(""))
    e = e.withColumn("search_text", F.lit(""))
    return inherit_tool_type(e).filter("event_kind = 'tool_result'").select("event_id", "tool_type")


@query(q("""SELECT event_id, CASE WHEN k % 4 = 0 AND event_kind <> 'user' THEN 'session-model' WHEN k % 4 = 0 THEN '' ELSE model END AS model
  FROM ev""", EVENTS))
def model_backfill(spark, sf):
    own = F.when(F.col("k") % 4 == 0, " ").otherwise(F.col("model"))
    e = D.events(spark, sf)
    return e.select("event_id", F.trim(cursor.backfilled_model(F.col("event_kind"), own, F.lit("session-model"))).alias("model"))


# ---- format jobs over log rows made of the tables -------------------------------------------------------------------


_KEYS = ("event_id", "index", "ts_ms", "session_id", "event_kind", "raw_type", "preview", "tool_name", "tool_type", "tool_call_id",
         "has_error", "search_text")


def _iso():
    return F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _by_type(view, click, purchase, error, signup):
    t = F.col("raw_type")
    return (F.when(t == "view", view).when(t == "click", click).when(t == "purchase", purchase).when(t == "error", error).otherwise(signup))


_S = F.struct
_K = lambda: F.col("k").cast("string")


_SEEN = """sn AS (SELECT *, last_value(CASE WHEN raw_type = 'click' THEN 'tool_' || k % 9 END IGNORE NULLS) OVER (PARTITION BY trace_id,
  CASE WHEN tool_use_id = '' THEN event_id ELSE tool_use_id END ORDER BY seq) AS seen FROM ev)"""


@query(q("""SELECT trace_id || ':' || index || ':' || seq * 100 AS event_id, index, ts_ms, coalesce(first_value(CASE WHEN raw_type = 'signup' THEN 's' || k END
  IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS session_id,
  CASE raw_type WHEN 'signup' THEN 'meta' WHEN 'view' THEN 'assistant' WHEN 'click' THEN 'tool_use' ELSE 'tool_result' END AS event_kind,
  CASE raw_type WHEN 'signup' THEN 'session_meta' WHEN 'view' THEN 'output_text' WHEN 'click' THEN 'function_call' ELSE 'function_call_output' END AS raw_type,
  CASE raw_type WHEN 'signup' THEN 'session_meta: s' || k WHEN 'view' THEN 'seen ' || k WHEN 'click' THEN tool_name || ': {"z":' || k || ',"a":1}'
   WHEN 'error' THEN '{"error":"e' || k || '"}' ELSE 'out ' || k END AS preview, tool_name, CASE raw_type WHEN 'click' THEN tool_name WHEN 'purchase' THEN
  coalesce(seen, '') WHEN 'error' THEN coalesce(seen, '') ELSE '' END AS tool_type, tool_use_id AS tool_call_id, has_error,
  CASE raw_type WHEN 'signup' THEN concat_ws(chr(10), 'session_meta', 's' || k, '/w', '1') WHEN 'view' THEN concat_ws(chr(10), 'response_item', 'message',
  'output_text', 'assistant', 'seen ' || k) WHEN 'click' THEN concat_ws(chr(10), 'response_item', 'function_call', tool_name, k, tool_name, '{"z":' || k || ',"a":1}')
  ELSE concat_ws(chr(10), 'response_item', 'function_call_output', k, coalesce(seen, ''), CASE raw_type WHEN 'error' THEN '{"error":"e' || k || '"}' ELSE 'out ' || k END) END AS search_text
  FROM sn""", EVENTS, _SEEN))
def normalize_codex(spark, sf):
    item = lambda *p: F.to_json(_S(_iso().alias("timestamp"), F.lit("response_item").alias("type"), _S(*p).alias("payload")))
    typ = lambda t: F.lit(t).alias("type")
    raw = _by_type(
        item(typ("message"), F.lit("assistant").alias("role"), F.array(_S(typ("output_text"), F.concat(F.lit("seen "), "k").alias("text"))).alias("content")),
        item(typ("function_call"), F.col("tool_name").alias("name"), _K().alias("call_id"), F.concat(F.lit('{"z":'), "k", F.lit(',"a":1}')).alias("arguments")),
        item(typ("function_call_output"), _K().alias("call_id"), F.concat(F.lit("out "), "k").alias("output")),
        item(typ("function_call_output"), _K().alias("call_id"), _S(F.concat(F.lit("e"), "k").alias("error")).alias("result")),
        F.to_json(_S(_iso().alias("timestamp"), typ("session_meta"), _S(F.concat(F.lit("s"), "k").alias("id"), F.lit("/w").alias("cwd"), F.lit("1").alias("cli_version")).alias("payload"))))
    e = D.events(spark, sf)
    return codex.normalize(_render(e, raw)).select(*_KEYS)


def _render(e, raw):
    return e.select("trace_id", F.concat(F.lit("/logs/p_"), "trace_id", F.lit(".jsonl")).alias("path"), F.col("index").alias("row_no"),
                    (F.col("index") * 100).alias("offset"), F.lit(0).cast("bigint").alias("mtime_ms"), raw.alias("raw_json")) \
        .withColumn("v", F.try_parse_json("raw_json"))


@query(q("""SELECT trace_id || ':' || row_number() OVER (PARTITION BY trace_id ORDER BY seq, part) || ':' || seq * 100 + part AS event_id,
  ts_ms, first_value(CASE WHEN raw_type = 'signup' THEN NULL ELSE 'c' || k END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN
  UNBOUNDED PRECEDING AND CURRENT ROW) AS session_id, kind AS event_kind, tool_type, preview, err AS has_error FROM (
  SELECT trace_id, seq, 0 AS part, ts_ms, raw_type, k, CASE raw_type WHEN 'signup' THEN 'user' WHEN 'view' THEN 'reasoning' WHEN 'click' THEN 'tool_use'
  ELSE 'tool_result' END AS kind, CASE raw_type WHEN 'click' THEN tool_name WHEN 'signup' THEN '' WHEN 'view' THEN '' ELSE coalesce(seen, '') END AS tool_type,
  CASE raw_type WHEN 'signup' THEN 'plain ' || k WHEN 'view' THEN 'deep ' || k WHEN 'click' THEN tool_name || ': {"z":' || k || '}' ELSE 'res ' || k END AS preview,
  has_error AS err FROM sn UNION ALL SELECT trace_id, seq, 1, ts_ms, raw_type, k, 'assistant', '', 'then ' || k, false FROM sn WHERE raw_type = 'view')""",
         EVENTS, _SEEN))
def normalize_claude(spark, sf):
    typ = lambda t: F.lit(t).alias("type")
    row = lambda t, content: F.to_json(_S(typ(t), F.concat(F.lit("c"), "k").alias("sessionId"), _iso().alias("timestamp"), _S(F.lit(t).alias("role"), content.alias("content")).alias("message")))
    res = lambda bad: row("user", F.array(_S(typ("tool_result"), _K().alias("tool_use_id"), F.lit(bad).alias("is_error"),
                                             F.array(_S(typ("text"), F.concat(F.lit("res "), "k").alias("text"))).alias("content"))))
    think = F.array(_S(typ("thinking"), F.concat(F.lit("deep "), "k").alias("thinking"), F.lit(None).cast("string").alias("text")),
                    _S(typ("text"), F.lit(None).cast("string").alias("thinking"), F.concat(F.lit("then "), "k").alias("text")))
    raw = _by_type(row("assistant", think),
                   row("assistant", F.array(_S(typ("tool_use"), _K().alias("id"), F.col("tool_name").alias("name"), _S(F.col("k").alias("z")).alias("input")))),
                   res(False), res(True),
                   F.to_json(_S(typ("user"), _iso().alias("timestamp"), _S(F.lit("user").alias("role"), F.concat(F.lit("plain "), "k").alias("content")).alias("message"))))
    return claude.normalize(_render(D.events(spark, sf), raw)).select("event_id", "ts_ms", F.nullif("session_id", F.lit("")).alias("session_id"),
                                                                      "event_kind", "tool_type", "preview", "has_error")


@query(q("""SELECT trace_id || ':' || index || ':' || seq * 100 AS event_id, ts_ms, coalesce(last_value(CASE WHEN raw_type = 'signup' THEN 'pi' || k END IGNORE NULLS)
  OVER (PARTITION BY trace_id ORDER BY seq), trace_id) AS session_id, CASE raw_type WHEN 'signup' THEN 'meta' WHEN 'view' THEN 'reasoning' WHEN 'click' THEN 'tool_use'
  ELSE 'tool_result' END AS event_kind, CASE raw_type WHEN 'signup' THEN 'session: pi' || k WHEN 'view' THEN 'deep ' || k WHEN 'click' THEN tool_name || ': {"z":' || k || '}'
  ELSE 'res ' || k END AS preview, CASE WHEN raw_type IN ('click', 'purchase', 'error') THEN 'tool_' || k % 9 ELSE '' END AS tool_type, has_error FROM ev""", EVENTS))
def normalize_pi(spark, sf):
    typ = lambda t: F.lit(t).alias("type")
    msg = lambda *p: F.to_json(_S(typ("message"), _iso().alias("timestamp"), _S(*p).alias("message")))
    tool = F.concat(F.lit("tool_"), F.col("k") % 9)
    res = lambda bad: msg(F.lit("toolResult").alias("role"), _K().alias("toolCallId"), tool.alias("toolName"), F.lit(bad).alias("isError"),
                          F.array(_S(typ("text"), F.concat(F.lit("res "), "k").alias("text"))).alias("content"))
    bot = lambda item: msg(F.lit("assistant").alias("role"), F.array(item).alias("content"))
    raw = _by_type(bot(_S(typ("thinking"), F.concat(F.lit("deep "), "k").alias("thinking"))),
                   bot(_S(typ("toolCall"), _K().alias("id"), tool.alias("name"), _S(F.col("k").alias("z")).alias("arguments"))),
                   res(False), res(True), F.to_json(_S(typ("session"), F.concat(F.lit("pi"), "k").alias("id"), _iso().alias("timestamp"))))
    return pi.normalize(_render(D.events(spark, sf), raw)).select("event_id", "ts_ms", "session_id", "event_kind", "preview", "tool_type", "has_error")


@query(q("""SELECT trace_id || ':' || index || ':' || seq * 100 AS event_id, ts_ms, '' AS session_id, 'meta' AS event_kind, raw_type, raw_type AS preview,
  raw_type || chr(10) || raw_type AS search_text FROM ev""", EVENTS))
def normalize_generic(spark, sf):
    raw = F.to_json(_S(F.col("raw_type").alias("type"), F.col("ts_ms").alias("ts")))
    return generic.normalize(_render(D.events(spark, sf), raw)).select("event_id", "ts_ms", "session_id", "event_kind", "raw_type", "preview", "search_text")


_GEM = """gm AS (SELECT trace_id, seq, 0 AS slot, 'reasoning' AS kind, 'deep ' || k AS preview, false AS err, ts_ms FROM ev WHERE raw_type = 'view' UNION ALL
  SELECT trace_id, seq, 900, 'assistant', 'said ' || k, false, ts_ms FROM ev WHERE raw_type = 'view' UNION ALL
  SELECT trace_id, seq, 900, 'user', 'ask ' || k, false, ts_ms FROM ev WHERE raw_type = 'signup' UNION ALL
  SELECT trace_id, seq, 600, 'tool_use', 'tool_' || k % 9 || ': {"z":' || k || '}', false, ts_ms FROM ev WHERE raw_type IN ('click', 'purchase', 'error') UNION ALL
  SELECT trace_id, seq, 601, 'tool_result', CASE raw_type WHEN 'click' THEN '{"output":"res ' || k || '"}' WHEN 'purchase' THEN 'shown ' || k ELSE 'error' END,
  raw_type = 'error', ts_ms FROM ev WHERE raw_type IN ('click', 'purchase', 'error'))"""


@query(q("""SELECT trace_id || ':' || row_number() OVER (PARTITION BY trace_id ORDER BY seq, slot) || ':' || seq * 100 + CASE slot WHEN 0 THEN 500 ELSE slot END AS event_id,
  ts_ms, 'doc' || trace_id AS session_id, kind AS event_kind, preview, err AS has_error FROM gm""", EVENTS, _GEM))
def normalize_gemini(spark, sf):
    typ = lambda t: F.lit(t).alias("type")
    tool = F.concat(F.lit("tool_"), F.col("k") % 9)
    call = lambda *more: F.to_json(_S(typ("gemini"), _iso().alias("timestamp"), F.array(_S(_K().alias("id"), tool.alias("name"), _S(F.col("k").alias("z")).alias("args"), *more)).alias("toolCalls")))
    answer = F.array(_S(_S(_S(F.concat(F.lit("res "), "k").alias("output")).alias("response")).alias("functionResponse")))
    raw = _by_type(F.to_json(_S(typ("gemini"), _iso().alias("timestamp"), F.concat(F.lit("said "), "k").alias("content"), F.array(_S(F.concat(F.lit("deep "), "k").alias("text"))).alias("thoughts"))),
                   call(answer.alias("result")), call(F.concat(F.lit("shown "), "k").alias("resultDisplay")), call(F.lit("error").alias("status")),
                   F.to_json(_S(typ("user"), _iso().alias("timestamp"), F.array(_S(F.concat(F.lit("ask "), "k").alias("text"))).alias("content"))))
    rows = _render(D.events(spark, sf), raw).withColumn("doc_session_id", F.concat(F.lit("doc"), "trace_id"))
    return gemini.normalize(rows).select("event_id", "ts_ms", "session_id", "event_kind", "preview", "has_error")


@query(q("""SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY index) AS index, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS event_kind,
  CASE WHEN length(f) <= 140 THEN f ELSE f[:139] || '…' END AS preview FROM (SELECT *, regexp_extract(regexp_replace(text, '^\\s+|\\s+$', '', 'g'),
  '^([^\\r\\n]*)', 1) AS f FROM tu)""", TURNS))
def normalize_cursor(spark, sf):
    t = D.turns(spark, sf)
    line = F.to_json(_S("role", _S(F.array(_S(F.lit("text").alias("type"), F.col("preview").alias("text"))).alias("content")).alias("message")))
    rows = t.select("trace_id", F.concat(F.lit("/x/"), "trace_id", F.lit(".jsonl")).alias("path"), F.lit(1).cast("bigint").alias("size_bytes"),
                    F.lit(1_700_000_000_000).alias("mtime_ms"), F.col("index").alias("row_no"), (F.col("index") * 10).alias("offset"), line.alias("line"))
    return cursor.finish(cursor.normalize_jsonl(rows), None).select("trace_id", "index", "event_kind", "preview")


# every conversation is a session, its turns are messages, the lines of a turn are parts
def _entities(spark, sf):
    t = D.table(spark, sf, "conversations")
    sid, mid = F.concat(F.lit("s"), "conv_id"), F.concat(F.lit("m"), "conv_id", F.lit("_"), F.lpad(F.col("turn").cast("string"), 20, "0"))

    def t_(df, key, owner, raw):
        return df.select(key.alias("key"), owner.alias("owner"), F.concat(owner, F.lit("/"), key).alias("path"), F.lit(1).cast("bigint").alias("size_bytes"),
                         F.lit(0).cast("bigint").alias("mtime_ms"), raw.alias("raw_json")).withColumn("v", F.try_parse_json("raw_json"))
    conv = t.select("conv_id").distinct()
    sessions = t_(conv, sid, F.lit("p"), F.to_json(_S(sid.alias("id"), F.concat(F.lit("T"), "conv_id").alias("title")))).withColumn("trace_id", F.col("key"))
    # a turn whose number leaves 5 claims another session and must be dropped
    own = F.when(F.col("turn") % 6 == 5, "other").when(F.col("turn") % 2 == 0, sid).otherwise("")
    messages = t_(t, mid, sid, F.to_json(_S(mid.alias("id"), own.alias("sessionID"), "role", _S((F.col("turn") * 1000 + 1_700_000_000_000).alias("created")).alias("time"))))
    lines = t.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    pid = F.concat(F.lit("p"), F.lpad(F.col("n").cast("string"), 20, "0"))
    parts = t_(lines, pid, mid, F.to_json(_S(pid.alias("id"), F.lit("text").alias("type"), F.col("line").alias("text"))))
    return sessions, messages, parts


_LINES = """ln AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM conversations WHERE turn % 6 <> 5)"""


@query(q("""SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY turn, n) AS index, kind AS event_kind, txt AS text FROM (SELECT DISTINCT 's' || conv_id AS trace_id,
  -1 AS turn, 0 AS n, 'meta' AS kind, 'T' || conv_id AS txt FROM conversations UNION ALL SELECT 's' || conv_id, turn, n, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END,
  line FROM ln)""", _LINES))
def entity_join(spark, sf):
    s, m, p = _entities(spark, sf)
    ev = opencode.normalize(s, m, p)
    return ev.select("trace_id", "index", "event_kind", F.coalesce(F.get("text_blocks", F.lit(0)), F.lit("")).alias("text"))


@query(q("""SELECT 's' || conv_id AS trace_id, count(*) + 1 AS events, count(*) FILTER (WHERE conv_id % 3 = 0) AS exported FROM ln GROUP BY conv_id""", _LINES))
def entity_fallback(spark, sf):
    """Every third conversation exists only in the exported tables; the others are there too, but files win."""
    s, m, p = _entities(spark, sf)
    third = F.regexp_extract("owner", r"^[sm](\d+)", 1).cast("bigint") % 3 == 0
    mark = lambda df, where: df.withColumn("raw_json", F.regexp_replace("raw_json", r"^\{", f'{{"from":"{where}",')).withColumn("v", F.try_parse_json("raw_json"))
    ev = opencode.normalize(s, mark(m.filter(~third), "files"), p, mark(m, "export"))
    return ev.groupBy("trace_id").agg(F.count(F.lit(1)).alias("events"),
                                      F.count_if(F.get_json_object("raw_json", "$.message.from") == "export").alias("exported"))


@query(q("""SELECT 's' || conv_id AS trace_id, count(*) AS parts, count(DISTINCT turn) AS messages, min(1700000000000 + turn * 1000) AS first_ts FROM ln
  GROUP BY conv_id""", _LINES))
def normalize_opencode(spark, sf):
    s, m, p = _entities(spark, sf)
    ev = opencode.normalize(s, m, p).filter("event_kind <> 'meta'")
    return ev.groupBy("trace_id").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct(F.get_json_object("raw_json", "$.message.id")).alias("messages"),
                                      F.min("ts_ms").alias("first_ts"))


@query(q("""SELECT 's' || conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'f' || conv_id ELSE 'e' || conv_id END AS title, 'e' || conv_id AS slug
  FROM (SELECT DISTINCT conv_id FROM conversations)"""))
def session_overlay(spark, sf):
    c = D.table(spark, sf, "conversations").select("conv_id").distinct()
    s = F.concat(F.lit("s"), "conv_id").alias("session_id")
    nul, ms = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    rest = [nul.alias("version"), nul.alias("directory"), nul.alias("project_id"), ms.alias("created_ms"), ms.alias("updated_ms")]
    files = c.select(s, F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("f"), "conv_id")).alias("title"), nul.alias("slug"), *rest)
    exported = c.select(s, F.concat(F.lit("e"), "conv_id").alias("title"), F.concat(F.lit("e"), "conv_id").alias("slug"), *rest)
    return opencode.overlay_sessions(files, exported).select("session_id", "title", "slug")


@query(q("""SELECT DISTINCT 's' || conv_id AS session_id, 'mod' || conv_id AS model, 1700000000000 + conv_id AS created_ms FROM conversations"""))
def session_side_table(spark, sf):
    c = D.table(spark, sf, "conversations").select("conv_id").distinct()
    doc = F.to_json(_S(F.concat(F.lit("mod"), "conv_id").alias("lastUsedModel"), (F.col("conv_id") + 1_700_000_000_000).alias("createdAt")))
    meta = c.select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.lit("0").alias("key"),
                    F.when(F.col("conv_id") % 2 == 0, F.hex(F.encode(doc, "UTF-8"))).otherwise(doc).alias("value"))
    return cursor.session_metadata(meta)


@query("""SELECT doc_id, string_agg(line, '|' ORDER BY f) AS blocks FROM (SELECT doc_id, line, min(n) AS f FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS n FROM (SELECT doc_id, replace(text, chr(13), '') AS text FROM documents)) WHERE line <> '' GROUP BY ALL) GROUP BY doc_id""")
def distinct_blocks(spark, sf):
    d = D.table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\r"), F.lit("")))
    items = F.transform(F.split("text", "\n"), lambda t: _S(F.trim(t).alias("text")))
    v = F.try_parse_json(F.to_json(_S(items.alias("content"))))
    return d.withColumn("v", v).select("doc_id", F.array_join(gemini.row_blocks(), "|").alias("blocks")).filter("blocks <> ''")


# ---- files --------------------------------------------------------------------------------------------------------


def _written_lines(spark, df):
    """Writes one text column to the shared folder and gives its path."""
    path = scratch_dir(spark)
    df.write.text(path)
    return path


@query(q("""SELECT seq, user_id, raw_type, k FROM ev WHERE k % 13 <> 0""", EVENTS))
def jsonl_scan(spark, sf):
    """Log files with blank, broken and non-object lines among the rows."""
    k = F.col("k")
    good = F.to_json(_S(F.col("index").alias("seq"), F.col("trace_id").cast("bigint").alias("user_id"), "raw_type", "k"))
    bad = F.when(k % 2 == 0, "{broken").otherwise("[1, 2]")
    line = F.when(k % 13 == 0, bad).otherwise(F.concat(good, F.lit("  \r")))
    rows = scan.json_rows(scan.lines(spark, [_written_lines(spark, D.events(spark, sf).select(line))]))
    n = lambda p: F.try_variant_get("v", p, "bigint")
    return rows.select(n("$.seq").alias("seq"), n("$.user_id").alias("user_id"), V.text(F.col("v"), "$.raw_type").alias("raw_type"), n("$.k").alias("k"))


@query(q("SELECT event_id, preview, ts_ms FROM ev", EVENTS))
def json_sink(spark, sf):
    path = scratch_dir(spark)
    scan.write_jsonl(D.events(spark, sf).select("event_id", "preview", "ts_ms"), path)
    return spark.read.schema("event_id string, preview string, ts_ms bigint").json(path)


_PATHS = """pa AS (SELECT seq, CASE k % 7 WHEN 0 THEN '/h/.codex/sessions/d/r' || seq || '.jsonl' WHEN 1 THEN '/h/.claude/projects/p/' || seq || '.jsonl'
  WHEN 2 THEN '/h/.cursor/projects/p/agent-transcripts/' || seq || '.txt' WHEN 3 THEN '/h/.gemini/tmp/x/chats/session-' || seq || '.json'
  WHEN 4 THEN '/h/.pi/agent/sessions/' || seq || '.jsonl' WHEN 5 THEN '/h/.claude/projects/p/subagents/agent-acompact-' || seq || '.jsonl'
  ELSE '/h/other/' || seq || '.jsonl' END AS path, k, ts_ms FROM ev)"""


def _paths(spark, sf):
    e, s, m = D.events(spark, sf), F.col("index").cast("string"), F.col("k") % 7
    path = (F.when(m == 0, F.concat(F.lit("/h/.codex/sessions/d/r"), s, F.lit(".jsonl"))).when(m == 1, F.concat(F.lit("/h/.claude/projects/p/"), s, F.lit(".jsonl")))
            .when(m == 2, F.concat(F.lit("/h/.cursor/projects/p/agent-transcripts/"), s, F.lit(".txt")))
            .when(m == 3, F.concat(F.lit("/h/.gemini/tmp/x/chats/session-"), s, F.lit(".json")))
            .when(m == 4, F.concat(F.lit("/h/.pi/agent/sessions/"), s, F.lit(".jsonl")))
            .when(m == 5, F.concat(F.lit("/h/.claude/projects/p/subagents/agent-acompact-"), s, F.lit(".jsonl"))).otherwise(F.concat(F.lit("/h/other/"), s, F.lit(".jsonl"))))
    return e.select(F.col("index").alias("seq"), path.alias("path"), "k", F.col("ts_ms").alias("mtime_ms"), s.alias("trace_id"))


@query(q("""SELECT path, CASE k % 7 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'cursor' WHEN 3 THEN 'gemini' ELSE 'pi' END AS agent_hint,
  'session_log' AS source_profile FROM pa WHERE k % 7 < 5""", EVENTS, _PATHS))
def path_rules(spark, sf):
    return scan.discover(_paths(spark, sf), home="/h").select("path", "agent_hint", "source_profile")


@query(q("""SELECT path, CASE k % 7 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'cursor' WHEN 3 THEN 'gemini' WHEN 4 THEN 'pi' WHEN 5 THEN 'claude' END AS agent
  FROM pa""", EVENTS, _PATHS))
def path_attribution(spark, sf):
    return _paths(spark, sf).select("path", scan.attribution(F.col("path"), home="/h")["agent_hint"].alias("agent"))


@query(q("""SELECT path, CASE k % 7 WHEN 0 THEN 'codex' WHEN 2 THEN 'cursor' WHEN 3 THEN 'gemini' WHEN 4 THEN 'pi' ELSE 'claude' END AS format,
  CASE k % 7 WHEN 0 THEN 0.7 WHEN 1 THEN 0.1 WHEN 2 THEN 0 WHEN 4 THEN 0.3 WHEN 5 THEN 0.1 WHEN 6 THEN 0.1 ELSE 0 END AS codex_score FROM pa""", EVENTS, _PATHS))
def format_scores(spark, sf):
    r, p, head = FormatRegistry(), F.col("path"), F.lit('{"sessionId": "x"}')
    return _paths(spark, sf).select("path", r.choose(p, head).alias("format"), r.scores(p, head)["codex"].cast("double").alias("codex_score"))


@query(q("""SELECT count(*) AS relevant, count(*) FILTER (WHERE k % 4 <> 0) AS processed, CAST(floor(count(*) FILTER (WHERE k % 4 <> 0) / count(*) * 100 + 0.5) AS BIGINT) AS percent,
  false AS ready FROM pa WHERE ts_ms >= 1705000000000""", EVENTS, _PATHS))
def ingest_coverage(spark, sf):
    f = _paths(spark, sf)
    return scan.coverage(f, f.filter("k % 4 <> 0"), 1_705_000_000_000)


@query(q("SELECT path, CASE WHEN k % 5 = 0 THEN 'no parseable rows' ELSE '' END AS parse_error FROM pa", EVENTS, _PATHS))
def ingest_errors(spark, sf):
    f = _paths(spark, sf).withColumn("size_bytes", F.lit(10))
    lines = f.withColumn("line", F.when(F.col("k") % 5 == 0, "oops").otherwise('{"a":1}'))
    return scan.ingest_errors(f, scan.json_rows(lines.select("trace_id", "line"))).select("path", "parse_error")


@query(q("""SELECT trace_id, row_no, 'x' || k AS text FROM (SELECT trace_id || '/' || seq // 1000 AS trace_id, k, row_number() OVER (PARTITION BY trace_id, seq // 1000
  ORDER BY seq) - 1 AS row_no FROM ev)""", EVENTS))
def document_scan(spark, sf):
    """JSON documents unpacked into their message rows; a document holds at most a thousand messages of a session."""
    part = F.floor(F.col("index") / 1000).cast("bigint")
    docs = D.events(spark, sf).groupBy(F.concat_ws("/", "trace_id", part).alias("trace_id")).agg(
        F.sort_array(F.collect_list(_S("index", "k"))).alias("a"))
    body = F.to_json(_S(F.lit("d").alias("sessionId"), F.transform("a", lambda x: _S(F.concat(F.lit("x"), x["k"]).alias("text"))).alias("messages")))
    docs = docs.select("trace_id", F.lit("/d.json").alias("path"), F.lit(1).cast("bigint").alias("size_bytes"), F.lit(0).cast("bigint").alias("mtime_ms"), body.alias("text"))
    return scan.document_rows(docs).select("trace_id", "row_no", V.text(F.col("v"), "$.text").alias("text"))


@query(q("""SELECT trace_id, role, block_no, line FROM (SELECT trace_id, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, CAST(row_number() OVER (PARTITION BY trace_id
  ORDER BY index) AS BIGINT) AS block_no, unnest(string_split(text, chr(10))) AS line FROM tu)""", TURNS))
def transcript_scan(spark, sf):
    t = D.turns(spark, sf)
    head = F.when(F.col("role") == "user", "User:  ").otherwise("ASSISTANT:")
    lines = t.select("trace_id", "index", F.posexplode(F.concat(F.array(head), F.split("preview", "\n"))).alias("n", "line"))
    order = F.shiftleft(F.col("index"), 32) + F.col("n")   # a text has fewer than 2**32 lines
    rows = lines.select("trace_id", order.alias("row_no"), order.alias("offset"), "line")
    return scan.role_blocks(rows).select("trace_id", "role", F.col("block_no").cast("bigint").alias("block_no"), "line")
