"""Queries on finding and paging, set operations, matching, retention and redaction."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as X
from ..functions import variants as V
from ..operators import activity as A
from ..operators import browse as B
from ..operators import lanes as L
from ..operators import match as M
from ..operators import sets as T
from ..operators.pricing import overlay, rate_table, with_rates
from ..operators.redact import redact_text
from ..params import RedactionParams, RetentionParams
from . import datasets as D
from .activity_queries import BASE, DAY, DAY_SQL, Report
from .oracle import EVENTS, NORMALISED, RATES, SEG, SESS, q
from .registry import query


@query(q("SELECT event_id, index, ts_ms, event_kind, preview FROM ev WHERE trace_id = '8'", EVENTS))
def session_detail(spark, sf):
    return B.session_detail(D.indexed(spark, sf), "8").select("event_id", "index", "ts_ms", "event_kind", "preview")


@query(q("""SELECT trace_id, event_id, live_cursor, greatest(live_cursor - 10, 0) AS next_before FROM (SELECT trace_id,
  event_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq DESC) AS back, count(*) OVER (PARTITION BY trace_id)
  AS live_cursor FROM ev WHERE event_kind <> 'user') WHERE back <= 10""", EVENTS))
def page_events(spark, sf):
    e = B.of_kinds(D.events(spark, sf), ["assistant", "tool_use", "tool_result"])
    return B.event_page(e, 10).select("trace_id", "event_id", "live_cursor", "next_before")


@query(q("""SELECT trace_id, event_id, n AS live_cursor, nb AS next_before FROM (SELECT *, greatest(least(40, n) - 15, 0)
  AS nb FROM (SELECT trace_id, event_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS place,
  count(*) OVER (PARTITION BY trace_id) AS n FROM ev)) WHERE place <= 40 AND place > nb""", EVENTS))
def page_before_cursor(spark, sf):
    return B.event_page(D.events(spark, sf), 15, before=40).select("trace_id", "event_id", "live_cursor", "next_before")


@query(q("""SELECT trace_id, agent, mtime_ms FROM sess WHERE agent = 'codex' ORDER BY mtime_ms DESC, path LIMIT 15""",
         EVENTS, SESS))
def recent_sessions(spark, sf):
    return B.recent_sessions(D.sessions(spark, sf), " Codex ", 15).select("trace_id", "agent", "mtime_ms")


@query(q("SELECT trace_id, last_ts_ms FROM sess ORDER BY last_ts_ms DESC, path, trace_id LIMIT 20", EVENTS, SESS))
def candidate_sessions(spark, sf):
    return B.candidate_sessions(D.sessions(spark, sf)).select("trace_id", "last_ts_ms")


@query(q(f"SELECT trace_id, event_count FROM sess WHERE last_ts_ms >= {D.NOW_MS} - 93600000 AND agent = 'claude'", EVENTS, SESS))
def since_window(spark, sf):
    s = B.since(D.sessions(spark, sf), D.NOW_MS, 26 * 3_600_000)
    return B.of_agent(s, "claude").select("trace_id", "event_count")


_BUCKET_NOW = 1_706_600_000_000


@query(q(f"""SELECT bucket, trace_id, updated_ms, row_number() OVER (ORDER BY o, updated_ms DESC, path, trace_id) AS rank FROM (
  SELECT *, CASE WHEN age < 86400000 THEN 'today' WHEN age < 604800000 THEN 'last_7d' ELSE 'older' END AS bucket,
  CASE WHEN age < 86400000 THEN 0 WHEN age < 604800000 THEN 1 ELSE 2 END AS o FROM (SELECT trace_id, path,
  last_ts_ms AS updated_ms, greatest({_BUCKET_NOW} - last_ts_ms, 0) AS age FROM sess))""", EVENTS, SESS))
def recency_buckets(spark, sf):
    return B.recency_buckets(D.sessions(spark, sf), _BUCKET_NOW)


@query(q("SELECT trace_id, agent FROM sess WHERE contains(lower(path || ' ' || agent || ' ' || session_id || ' ' || trace_id), 'sess-1')",
         EVENTS, SESS))
def search_sessions(spark, sf):
    return B.search_sessions(D.sessions(spark, sf), " SESS-1 ").select("trace_id", "agent")


@query(q("""SELECT event_id, label FROM (SELECT event_id, preview AS label, tool_type, event_kind, index FROM ev)
  WHERE contains(index || ' ' || event_kind || ' ' || tool_type || ' ' || lower(label), 'type_3')""", EVENTS))
def search_contents(spark, sf):
    e = D.indexed(spark, sf).withColumn("toc_label", F.lit(""))
    return B.search_contents(B.contents(e), "TYPE_3").select("event_id", "label")


@query(q("""SELECT rank, CASE WHEN session_id = '' THEN '-' ELSE session_id END AS session_id, trace_id, agent, last_ts_ms
  AS updated_ms, event_count, error_count, tool_use_count, trace_id || '.jsonl' AS path_tail FROM (SELECT *, row_number()
  OVER (ORDER BY last_ts_ms DESC, path) AS rank FROM sess) WHERE rank <= 50""", EVENTS, SESS))
def history_rows(spark, sf):
    return B.history_rows(D.sessions(spark, sf))


@query(q("""SELECT trace_id, rank, CASE WHEN rank <= 20 THEN 0 ELSE (rank - 21) // 40 + 1 END AS page FROM (SELECT trace_id,
  row_number() OVER (ORDER BY mtime_ms DESC, path, trace_id) AS rank FROM sess)""", EVENTS, SESS))
def session_pages(spark, sf):
    return B.session_pages(D.sessions(spark, sf)).select("trace_id", "rank", "page")


@query(q("""SELECT candidate, coalesce(s.trace_id, n.trace_id) AS trace_id FROM (SELECT DISTINCT CASE WHEN user_id % 2 = 0
  THEN trace_id ELSE session_id END AS candidate FROM ev) c LEFT JOIN sess s ON s.trace_id = candidate LEFT JOIN (SELECT
  session_id, arg_min(trace_id, (-mtime_ms, path)) AS trace_id FROM sess WHERE session_id <> '' GROUP BY 1) n
  ON n.session_id = candidate""", EVENTS, SESS))
def resolve_id(spark, sf):
    e = D.events(spark, sf)
    c = e.select(F.when(F.col("trace_id").cast("bigint") % 2 == 0, F.col("trace_id")).otherwise(F.col("session_id")).alias("candidate"))
    return B.resolve_many(D.sessions(spark, sf), c.distinct())


def _raw(e):
    """Raw rows with models, policies and working directories in the places the badge and cwd rules look at."""
    k, typ = F.col("k"), F.col("raw_type")
    raw = (F.when(typ == "signup", F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(
        F.col("model"), F.concat(F.lit("p"), k % 3).alias("approval_policy")).alias("payload"))))
        .when(typ == "click", F.to_json(F.struct(F.lit("progress").alias("type"), F.struct(F.concat(F.lit("h"), k % 2).alias("hookEvent")).alias("data"))))
        .when(typ == "view", F.to_json(F.struct(F.lit("system").alias("type"), F.concat(F.lit("s"), k % 2).alias("subtype"), F.col("model"))))
        .otherwise(F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(
            F.when(k % 4 > 0, F.concat(F.lit(" /w/"), k)).otherwise("").alias("cwd")).alias("payload")))))
    return e.withColumn("raw_json", raw)


@query(q("""SELECT event_id, CASE raw_type WHEN 'signup' THEN 'model:' || model || ',approval:p' || k % 3 WHEN 'click' THEN
  'hook:h' || k % 2 WHEN 'view' THEN 'model:' || model || ',system:s' || k % 2 ELSE '' END AS tags FROM ev""", EVENTS))
def badges(spark, sf):
    tags = B.badges(F.try_parse_json("raw_json"))
    return _raw(D.events(spark, sf)).select("event_id", F.array_join(tags, ",").alias("tags"))


@query(q("""SELECT trace_id, '/w/' || arg_min(k, seq) AS cwd FROM ev WHERE raw_type IN ('purchase', 'error') AND k % 4 > 0
  GROUP BY trace_id""", EVENTS))
def session_cwd(spark, sf):
    e = _raw(D.events(spark, sf)).withColumn("raw_type", F.get_json_object("raw_json", "$.type"))
    return B.session_cwd(e)


_HALVES = """h AS (SELECT event_id, seq, preview || '-a' AS preview, 0 AS part FROM ev WHERE seq % 3 <> 0 UNION ALL
  SELECT event_id, seq, preview || '-b', 1 FROM ev WHERE seq % 3 <> 1)"""


def _halves(spark, sf):
    e = D.events(spark, sf)
    a = e.filter(F.col("index") % 3 != 0).select("event_id", F.concat("preview", F.lit("-a")).alias("preview"))
    b = e.filter(F.col("index") % 3 != 1).select("event_id", F.concat("preview", F.lit("-b")).alias("preview"))
    return [a, b]


@query(q("SELECT event_id, arg_min(preview, part) AS preview FROM h GROUP BY event_id", EVENTS, _HALVES))
def event_union_first(spark, sf):
    return T.union_first(_halves(spark, sf))


@query(q("SELECT event_id, arg_max(preview, part) AS preview FROM h GROUP BY event_id", EVENTS, _HALVES))
def event_upsert_last(spark, sf):
    return T.upsert_last(_halves(spark, sf))


@query(q("""SELECT trace_id, CASE WHEN u % 11 = 0 THEN 'new' WHEN u % 7 = 0 THEN 'vanished' WHEN u % 5 = 0 THEN 'grown'
  WHEN u % 3 = 0 THEN 'rewritten' ELSE 'same' END AS action FROM (SELECT trace_id, CAST(trace_id AS BIGINT) AS u FROM sess)""",
         EVENTS, SESS))
def change_actions(spark, sf):
    s = D.sessions(spark, sf).withColumn("u", F.col("trace_id").cast("bigint"))
    u = F.col("u")
    before = s.filter(u % 11 != 0).select("trace_id", F.col("event_count").alias("size_bytes"), "mtime_ms")
    grown = F.when(u % 5 == 0, 10).otherwise(0)
    now = s.filter((u % 11 == 0) | (u % 7 != 0)).select(
        "trace_id", (F.col("event_count") + grown).alias("size_bytes"),
        (F.col("mtime_ms") + F.when((u % 3 == 0) | (u % 5 == 0), 5).otherwise(0)).alias("mtime_ms"))
    return T.change_actions(before, now)


_DELTAS = """dl AS (SELECT seq AS version, CASE WHEN k % 9 = 0 THEN 'trace_added' WHEN k % 9 = 1 THEN 'trace_removed'
  WHEN k % 9 < 6 THEN 'trace_updated' WHEN k % 9 = 8 THEN 'overview_updated' ELSE 'events_appended' END AS type,
  CASE WHEN k % 9 = 8 THEN '' ELSE trace_id END AS trace_id, k AS appended, preview AS payload FROM ev),
dc AS (SELECT *, CASE WHEN type LIKE 'trace%' THEN 'trace' ELSE type END AS cls FROM dl)"""


@query(q("""SELECT trace_id, CASE WHEN cls <> 'trace' THEN cls WHEN lt = 'trace_removed' THEN lt WHEN a > coalesce(r, -1)
  THEN 'trace_added' ELSE 'trace_updated' END AS type, version, first_version, CASE WHEN cls = 'events_appended' THEN n END
  AS appended, payload FROM (SELECT trace_id, cls, max(version) AS version, min(version) AS first_version,
  arg_max(type, version) AS lt, arg_max(payload, version) AS payload, CAST(sum(appended) AS BIGINT) AS n,
  max(version) FILTER (WHERE type = 'trace_added') AS a, max(version) FILTER (WHERE type = 'trace_removed') AS r
  FROM dc GROUP BY trace_id, cls)""", EVENTS, _DELTAS))
def delta_coalesce(spark, sf):
    m = F.col("k") % 9
    typ = (F.when(m == 0, "trace_added").when(m == 1, "trace_removed").when(m < 6, "trace_updated").when(m == 8, "overview_updated")
           .otherwise("events_appended"))
    d = D.events(spark, sf).select(F.col("index").alias("version"), typ.alias("type"),
                                   F.when(m == 8, "").otherwise(F.col("trace_id")).alias("trace_id"), F.col("k").alias("appended"),
                                   F.col("preview").alias("payload"))
    return T.coalesced_deltas(d)


# Fixed values of the test: user rates laid over the defaults.
_USER_RATES = "(0, 'house-model', 2.0), (1, 'gpt-5.2-codex', 9.0)"


@query(q(f"""SELECT trace_id, count(*) AS rows, max(CAST(coalesce(u.rate, r.input_rate) AS DOUBLE)) AS input_rate,
  max(CASE WHEN norm = 'house-model' THEN 9 ELSE r.ord END) AS ord FROM (SELECT *, {NORMALISED} AS norm FROM ev) e
  LEFT JOIN rates r ON r.model = norm LEFT JOIN (VALUES {_USER_RATES}) u(o, model, rate) ON u.model = norm GROUP BY trace_id""",
         EVENTS, RATES))
def rate_overlay(spark, sf):
    defaults = rate_table(spark)
    user = spark.sql(f"SELECT * FROM VALUES {_USER_RATES} AS t(ord, model, rate)")
    other = [c for c in defaults.columns if c not in ("ord", "model", "input_rate")]
    user = user.select("ord", "model", F.col("rate").cast("decimal(12,6)").alias("input_rate"),
                       *[F.lit(None).cast(defaults.schema[c].dataType).alias(c) for c in other])
    merged = overlay(defaults, user)
    rows = with_rates(D.events(spark, sf), merged.withColumn("place", F.col("ord")))
    return rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("rate.input_rate").cast("double")).alias("input_rate"),
                                        F.max("rate.place").alias("ord"))


def _launches(spark, sf):
    """Launches made of sign-up events: command by agent, some naming a session, terminal and directory by number."""
    e = D.events(spark, sf).filter("raw_type = 'signup'")
    u, k = F.col("trace_id").cast("bigint"), F.col("k")
    cmd = F.concat(F.lit("/usr/bin/"), F.col("agent"), F.when(k % 3 == 0, F.concat(F.lit(" --resume sess-"), u)).otherwise(""))
    return e.select(F.col("index").alias("pid"), F.concat(F.lit("u"), u % 3).alias("user"), cmd.alias("args"),
                    F.concat(F.lit("/w/p"), (u * 7 + k) % 400).alias("cwd"), F.concat(F.lit("tty"), k % 40).alias("tty"),
                    F.col("ts_ms").alias("started_ms"), F.col("agent").alias("key"))


def _launched_sessions(spark, sf):
    u = F.col("trace_id").cast("bigint")
    p = F.concat(F.lit("w-p"), u % 400)
    path = (F.when(F.col("agent") == "claude", F.concat(F.lit("/h/.claude/projects/-"), p, F.lit("/s.jsonl")))
            .when(F.col("agent") == "cursor", F.concat(F.lit("/h/.cursor/projects/"), p, F.lit("/agent-transcripts/s.txt")))
            .when(F.col("agent") == "gemini", F.concat(F.lit("/h/.gemini/tmp/"), p, F.lit("/chats/s.json"))).otherwise(F.lit("/h/s.jsonl")))
    return D.sessions(spark, sf).select("trace_id", "agent", "session_id", F.concat(F.lit("u"), u % 3).alias("user"), path.alias("path"),
                                        F.concat(F.lit("/w/p"), u % 400).alias("cwd"), F.col("first_ts_ms").alias("start_ms"), F.col("agent").alias("key"))


_LAUNCH = """la AS (SELECT seq AS pid, 'u' || user_id % 3 AS usr, agent, CASE WHEN k % 3 = 0 THEN 'sess-' || user_id ELSE '' END
  AS sid, 'p' || (user_id * 7 + k) % 400 AS proj, 'tty' || k % 40 AS tty, ts_ms FROM ev WHERE raw_type = 'signup'),
ls AS (SELECT trace_id, agent, session_id, 'u' || CAST(trace_id AS BIGINT) % 3 AS usr,
  'p' || CAST(trace_id AS BIGINT) % 400 AS proj, first_ts_ms FROM sess WHERE agent <> 'unknown')"""


def _match_sql(on: str) -> str:
    return f"""SELECT DISTINCT trace_id, pid, how FROM (SELECT trace_id, pid, CASE WHEN named THEN 'session_id' ELSE 'only_candidate'
      END AS how, named, bool_or(named) OVER (PARTITION BY trace_id) AS any_named, count(*) OVER (PARTITION BY trace_id) AS n
      FROM (SELECT ls.trace_id, pid, sid <> '' AND sid = session_id AS named FROM ls JOIN la USING ({on})))
      WHERE named OR (NOT any_named AND n = 1)"""


@query(q(_match_sql("usr, agent, proj"), EVENTS, SESS, _LAUNCH))
def project_match(spark, sf):
    return M.match_by_project(_launched_sessions(spark, sf), _launches(spark, sf))


@query(q(_match_sql("usr, agent"), EVENTS, SESS, _LAUNCH))
def launch_match(spark, sf):
    return M.match_by_session_id(_launched_sessions(spark, sf), _launches(spark, sf))


@query(q("""SELECT trace_id, key, tty, distance_ms FROM (SELECT trace_id, ls.agent AS key, tty, abs(anchor - first_ts_ms) AS
  distance_ms, row_number() OVER (PARTITION BY trace_id ORDER BY abs(anchor - first_ts_ms), anchor, tty) AS rn,
  lead(abs(anchor - first_ts_ms)) OVER (PARTITION BY trace_id ORDER BY abs(anchor - first_ts_ms), anchor, tty) AS nxt
  FROM ls JOIN (SELECT agent, tty, min(ts_ms) AS anchor FROM la GROUP BY ALL) USING (agent)) WHERE rn = 1
  AND distance_ms IS DISTINCT FROM nxt""".replace("FROM ls JOIN", "FROM (SELECT *, CASE WHEN true THEN agent END AS a2 FROM ls) ls JOIN"),
         EVENTS, SESS, _LAUNCH.replace(" WHERE agent <> 'unknown'", "")))
def nearest_match(spark, sf):
    return M.nearest_group(_launched_sessions(spark, sf), _launches(spark, sf))


@query(q("""SELECT trace_id, CASE WHEN agent = 'cursor' THEN 'w-' || proj WHEN agent = 'claude' THEN '-w-' || proj WHEN agent =
  'gemini' THEN 'w-' || proj ELSE '-w-' || proj END AS key, CASE WHEN agent = 'gemini' THEN sha256('/w/' || proj) ||
  ',' || proj || ',w-' || proj WHEN agent = 'cursor' THEN 'w-' || proj ELSE '-w-' || proj END AS cwd_keys FROM ls""",
         EVENTS, SESS, _LAUNCH.replace(" WHERE agent <> 'unknown'", "")))
def project_keys(spark, sf):
    s = _launched_sessions(spark, sf)
    return s.select("trace_id", M.project_key(F.col("agent"), F.col("path"), F.col("cwd")).alias("key"),
                    F.array_join(M.launch_project_keys(F.col("agent"), F.col("cwd")), ",").alias("cwd_keys"))


@query(q("""SELECT trace_id, string_agg(DISTINCT 'ses_' || k, ',' ORDER BY 'ses_' || k) AS session_ids, CAST(arg_max(seq, seq)
  FILTER (WHERE raw_type IN ('error', 'purchase')) AS BIGINT) AS pid FROM ev GROUP BY trace_id""", EVENTS))
def log_ids(spark, sf):
    """Session ids and the last process id named by log lines, folded per log."""
    line = (F.when(F.col("raw_type") == "error", F.concat(F.lit("x .claude.json.tmp."), "index", F.lit(".y sessionID=ses_"), "k"))
            .when(F.col("raw_type") == "purchase", F.concat(F.lit("Acquired PID lock (PID "), "index", F.lit(") sessionID=ses_"), "k"))
            .otherwise(F.concat(F.lit("note sessionID=ses_"), "k")))
    e = D.events(spark, sf).withColumn("line", line).withColumn("pid", ids.debug_log_pid(F.col("line")))
    per = e.select("trace_id", "index", "pid", F.explode(ids.session_ids_in_log(F.col("line"))).alias("sid"))
    # at most a hundred distinct ids per log in this table; the pid folds as a maximum
    return per.groupBy("trace_id").agg(F.array_join(F.array_sort(F.collect_set("sid")), ",").alias("session_ids"),
                                       F.max_by("pid", F.when(F.col("pid").isNotNull(), F.col("index"))).alias("pid"))


_LANES = """bars AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY first_bin, trace_id) AS n FROM (SELECT day, trace_id, min(bin) AS first_bin, max(bin) AS last_bin
   FROM (SELECT *, bin - row_number() OVER (PARTITION BY day, trace_id ORDER BY bin) AS isl FROM act) GROUP BY day, trace_id, isl)),
 free AS (SELECT day, 0::BIGINT AS n, NULL::VARCHAR AS trace_id, NULL::INT AS first_bin, NULL::INT AS last_bin, 0::BIGINT AS lane, []::INT[] AS ends FROM (SELECT DISTINCT day FROM bars)
   UNION ALL SELECT day, n, trace_id, first_bin, last_bin, lane, list_concat(list_concat(ends[:lane - 1], [last_bin::INT]), ends[lane + 1:]) FROM (
     SELECT b.day, b.n, b.trace_id, b.first_bin, b.last_bin, f.ends, coalesce(list_position(list_transform(f.ends, lambda e: e < b.first_bin), true), len(f.ends) + 1) AS lane
     FROM free f JOIN bars b ON b.day = f.day AND b.n = f.n + 1))"""


@query(q("SELECT day, trace_id, first_bin, last_bin, lane - 1 AS lane FROM free WHERE n > 0", *BASE, DAY_SQL, _LANES).replace("WITH ", "WITH RECURSIVE ", 1))
def lanes(spark, sf):
    bars = A.session_bars(Report(spark, sf, DAY).bin_sessions)
    return L.assign_lanes(bars, ["day"]).select("day", "trace_id", "first_bin", "last_bin", "lane")


@query(q("""SELECT trace_id, CASE WHEN rn <= 10 THEN 'hot' WHEN rn <= 50 THEN 'warm' ELSE 'cold' END AS tier FROM (SELECT trace_id,
  row_number() OVER (ORDER BY mtime_ms DESC, path, trace_id) AS rn FROM sess)""", EVENTS, SESS))
def tiering(spark, sf):
    p = RetentionParams(hot_count=10, warm_count=40)
    return T.retention_tiers(D.sessions(spark, sf), p).select("trace_id", "tier")


@query(q("""SELECT event_id, tier FROM (SELECT event_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq DESC) AS back,
  CASE WHEN rn <= 10 THEN 'hot' ELSE 'warm' END AS tier FROM ev JOIN (SELECT trace_id, row_number() OVER (ORDER BY mtime_ms DESC,
  path, trace_id) AS rn FROM sess) USING (trace_id) WHERE rn <= 50) WHERE back <= CASE WHEN tier = 'hot' THEN 30 ELSE 5 END""",
         EVENTS, SESS))
def retained_events(spark, sf):
    p = RetentionParams(hot_count=10, warm_count=40, hot_events=30, warm_events=5)
    return T.retained_events(D.events(spark, sf), D.sessions(spark, sf), p).select("event_id", "tier")


# Fixed values of the test: patterns that occur in the documents.
_MAIL, _TOKEN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r'token = "[0-9a-f]+"'


@query(f"""SELECT doc_id, regexp_replace(text, '(?i)({_MAIL}|{_TOKEN})', '[REDACTED]', 'g') AS text FROM documents""")
def redact_documents(spark, sf):
    p = RedactionParams(value_pattern=f"(?i)({_MAIL}|{_TOKEN})")
    return D.table(spark, sf, "documents").select("doc_id", redact_text(F.col("text"), p).alias("text"))


@query(q("""SELECT event_id, '{"type":"' || raw_type || '","payload":{"api_key":"[REDACTED]","note":"uses [REDACTED] now"}}' AS raw_json, 'key [REDACTED]' AS text,
  lower(preview || chr(10) || raw_type || chr(10) || 'key [REDACTED]') || chr(10) || chr(10) AS search_text FROM ev""", EVENTS))
def redact_events(spark, sf):
    """Whole redaction job over raw rows with secrets under telling keys and in values."""
    from ..operators.redact import redact_events as job
    e = D.events(spark, sf)
    raw = F.to_json(F.struct(F.col("raw_type").alias("type"), F.struct(
        F.concat(F.lit("sk-"), "k").alias("api_key"), F.concat(F.lit("uses sk-abc"), "k", F.lit(" now")).alias("note")).alias("payload")))
    e = e.withColumns({"raw_json": raw, "text_blocks": F.array(F.concat(F.lit("key sk-z"), "k")), "tool_args_text": F.lit(""),
                       "tool_result_text": F.lit(""), "toc_label": F.col("preview")})
    return job(e).select("event_id", "raw_json", F.get("text_blocks", F.lit(0)).alias("text"), "search_text")
