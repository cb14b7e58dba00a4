"""Queries on sessions, tools, usage, cost and status."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..operators import usage_rows as U
from ..operators.ordered import running
from ..operators.pricing import rate_table, window_table, with_rates
from ..operators.segments import active_segments, segment_stats
from ..params import CostParams, StatusParams
from ..schemas import EVENT_KINDS
from . import datasets as D
from .oracle import COST, EVENTS, PRICED, SEG, SESS, TURNS, q
from .registry import query


def money(c):
    return F.round(c, 6).cast("double")


@query(q("""SELECT count(*) AS trace_count, count(*) FILTER (WHERE session_id <> '') AS session_count,
  CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(error_count) AS BIGINT) AS error_count,
  CAST(sum(tool_use_count) AS BIGINT) AS tool_use_count, CAST(sum(tool_result_count) AS BIGINT) AS tool_result_count
  FROM sess""", EVENTS, SESS))
def overview(spark, sf):
    return S.overview(D.sessions(spark, sf))


@query(q("""SELECT agent, count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events FROM sess GROUP BY agent
  ORDER BY sessions DESC, agent""", EVENTS, SESS))
def by_agent(spark, sf):
    return S.by_agent(D.sessions(spark, sf)).orderBy(F.desc("sessions"), "agent")


@query(q(f"""SELECT event_kind, count(ev.seq) AS events FROM (SELECT unnest([{', '.join(repr(k) for k in EVENT_KINDS)}])
  AS event_kind) LEFT JOIN ev USING (event_kind) GROUP BY 1""", EVENTS))
def by_kind(spark, sf):
    return S.by_kind(D.events(spark, sf))


@query(q("SELECT max(last_ts_ms) AS newest_ts_ms FROM sess", EVENTS, SESS))
def newest_event(spark, sf):
    return S.newest_event(D.sessions(spark, sf))


@query(q("""SELECT trace_id, event_count, error_count, tool_use_count, tool_result_count, 0::BIGINT AS compaction_count
  FROM sess""", EVENTS, SESS))
def session_counts(spark, sf):
    return D.sessions(spark, sf).select("trace_id", "event_count", "error_count", "tool_use_count",
                                        "tool_result_count", "compaction_count")


@query(q("SELECT trace_id, first_ts_ms, last_ts_ms FROM sess", EVENTS, SESS))
def first_last_file_order(spark, sf):
    return D.events(spark, sf).groupBy("trace_id").agg(*S.file_order_bounds())


@query(q("SELECT trace_id, " + ", ".join(
    f"count(*) FILTER (WHERE event_kind = '{k}') AS n_{k}" for k in EVENT_KINDS) + " FROM ev GROUP BY trace_id", EVENTS))
def kind_map(spark, sf):
    m = D.events(spark, sf).groupBy("trace_id").agg(S.kind_map().alias("m"))
    return m.select("trace_id", *[F.col("m")[k].alias(f"n_{k}") for k in EVENT_KINDS])


@query(q("""SELECT trace_id, count(*) FILTER (WHERE u AND NOT r) AS unmatched_tool_uses,
  count(*) FILTER (WHERE r AND NOT u) AS unmatched_tool_results FROM (SELECT trace_id, tool_use_id,
  bool_or(event_kind = 'tool_use') AS u, bool_or(event_kind = 'tool_result') AS r FROM ev WHERE tool_use_id <> ''
  GROUP BY ALL) GROUP BY trace_id""", EVENTS))
def unmatched_tools(spark, sf):
    return S.unmatched_tools(D.events(spark, sf))


_TOOLS = """tc AS (SELECT trace_id, tool_name AS name, count(*) AS count FROM ev WHERE event_kind = 'tool_use'
  GROUP BY ALL), tt AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY count DESC, name) AS rank FROM tc)"""


@query(q("SELECT trace_id, name, count, rank FROM tt WHERE rank <= 5", EVENTS, _TOOLS))
def top_tools_session(spark, sf):
    return S.top_tools(D.events(spark, sf), 5)


@query(q("""SELECT name, CAST(sum(count) AS BIGINT) AS count FROM tt WHERE rank <= 12 GROUP BY name
  ORDER BY count DESC, name LIMIT 12""", EVENTS, _TOOLS))
def top_tools_truncated(spark, sf):
    return S.top_tools_overall(D.events(spark, sf))


@query(q("""SELECT name, CAST(sum(count) AS BIGINT) AS count FROM tc GROUP BY name ORDER BY count DESC, name LIMIT 12""",
         EVENTS, _TOOLS))
def top_tools_exact(spark, sf):
    return S.top_tools_overall(D.events(spark, sf), exact=True)


@query(q("""SELECT tool_type, count(DISTINCT tool_type || ':' || tool_use_id) AS calls FROM ev WHERE tool_type <> ''
  GROUP BY tool_type""", EVENTS))
def tool_type_counts(spark, sf):
    return S.tool_type_counts(D.events(spark, sf))


@query(q("""SELECT trace_id, """ + ", ".join(
    f"CASE WHEN n > 0 THEN round({k} / n * 100, 2) ELSE 0 END AS {k}_pct"
    for k in ("assistant", "user", "tool_use", "tool_result")) + """ FROM (SELECT trace_id, """ + ", ".join(
    f"count(*) FILTER (WHERE event_kind = '{k}') AS {k}" for k in ("assistant", "user", "tool_use", "tool_result"))
    + ", assistant + user + tool_use + tool_result AS n FROM ev GROUP BY trace_id)", EVENTS))
def event_mix(spark, sf):
    return S.event_mix(D.events(spark, sf))


@query(q("SELECT trace_id, seg_no, start_ms, end_ms, n_events FROM seg", EVENTS, SEG))
def segments(spark, sf):
    return active_segments(D.events(spark, sf))


@query(q("""SELECT trace_id, count(*) AS segments, CAST(sum(n_events) AS BIGINT) AS events,
  CAST(sum(end_ms - start_ms) AS BIGINT) AS active_ms, max(end_ms - start_ms) AS longest_ms FROM seg GROUP BY trace_id""",
         EVENTS, SEG))
def segment_statistics(spark, sf):
    return segment_stats(active_segments(D.events(spark, sf)))


_BINS_SQL = """SELECT trace_id, mode AS activity_bins_mode, string_agg(CAST(CAST(round(n / mx * 1000) AS BIGINT) AS VARCHAR),
  ',' ORDER BY bin) AS bins FROM (SELECT trace_id, mode, b.bin, coalesce(n, 0) AS n,
  max(coalesce(n, 0)) OVER (PARTITION BY trace_id) AS mx FROM (SELECT DISTINCT trace_id, mode FROM src)
  CROSS JOIN (SELECT unnest(range(12)) AS bin) b LEFT JOIN (SELECT trace_id, least(greatest(raw, 0), 11) AS bin,
  count(*) AS n FROM src GROUP BY ALL) USING (trace_id, bin)) GROUP BY ALL"""


def _bin_text(df):
    scaled = F.transform("activity_bins", lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    return df.select("trace_id", "activity_bins_mode", F.array_join(scaled, ",").alias("bins"))


@query(q(_BINS_SQL, EVENTS, """src AS (SELECT trace_id, CASE WHEN timed THEN 'time' ELSE 'event_index' END AS mode,
  CAST(floor(CASE WHEN timed THEN (ts_ms - f) / (l - f) * 12 ELSE (index - 1) / n * 12 END) AS BIGINT) AS raw
  FROM (SELECT trace_id, ts_ms, index, first(ts_ms) OVER w AS f, last(ts_ms) OVER w AS l, count(*) OVER w AS n,
  n >= 2 AND l > f AS timed FROM ev WINDOW w AS (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
  AND UNBOUNDED FOLLOWING)))"""))
def lifetime_bins(spark, sf):
    e = D.indexed(spark, sf)
    stats = e.groupBy("trace_id").agg(F.count(F.lit(1)).alias("event_count"), *S.positive_bounds())
    return _bin_text(S.lifetime_bins(e, stats))


@query(q(_BINS_SQL, TURNS, """src AS (SELECT trace_id, 'event_index' AS mode,
  CAST(floor((row_number() OVER (PARTITION BY trace_id ORDER BY index) - 1)
  / count(*) OVER (PARTITION BY trace_id) * 12) AS BIGINT) AS raw FROM tu)"""))
def event_index_bins(spark, sf):
    t = D.turns(spark, sf)
    stats = t.groupBy("trace_id").agg(F.count(F.lit(1)).alias("event_count"), *S.positive_bounds())
    return _bin_text(S.lifetime_bins(t, stats))


@query(q("SELECT trace_id, seq AS row_no, CAST(cost_usd AS DOUBLE) AS cost_usd FROM us", EVENTS, PRICED))
def usage_cost_rows(spark, sf):
    return D.priced_rows(spark, sf).select("trace_id", "row_no", money(F.col("cost_usd")).alias("cost_usd"))


@query(q("""SELECT trace_id, CASE WHEN bool_or(cost_usd IS NULL) THEN NULL ELSE CAST(sum(cost_usd) AS DOUBLE) END
  AS cost_usd FROM us GROUP BY trace_id""", EVENTS, PRICED))
def session_cost(spark, sf):
    rows = D.priced_rows(spark, sf).withColumn("embedded_cost", F.lit(None).cast("decimal(18,6)"))
    return U.session_cost(rows).select("trace_id", money(F.col("cost_usd")).alias("cost_usd"))


@query(q("""SELECT trace_id, CAST(sum(coalesce(cost_usd, 0)) AS DOUBLE) AS cost_usd FROM us GROUP BY trace_id""",
         EVENTS, PRICED))
def cost_zero_policy(spark, sf):
    zero = CostParams(unknown_model_policy="zero")
    rows = U.priced(D.usage_rows(spark, sf), rate_table(spark), window_table(spark), zero)
    rows = rows.withColumn("embedded_cost", F.lit(None).cast("decimal(18,6)"))
    return U.session_cost(rows, zero).select("trace_id", money(F.col("cost_usd")).alias("cost_usd"))


@query(q("""SELECT trace_id, coalesce(CAST(sum(embedded_cost) AS DOUBLE), CASE WHEN bool_or(cost_usd IS NULL) THEN NULL
  ELSE CAST(sum(cost_usd) AS DOUBLE) END) AS cost_usd FROM us GROUP BY trace_id""", EVENTS, PRICED))
def embedded_cost(spark, sf):
    return U.session_cost(D.priced_rows(spark, sf)).select("trace_id", money(F.col("cost_usd")).alias("cost_usd"))


@query(q(f"""SELECT trace_id, CAST(sum({COST}) AS DOUBLE) AS cost_usd FROM (SELECT trace_id, norm, sum(input_tokens) AS input_tokens,
  sum(cached_read_tokens) AS cached_read_tokens, sum(output_tokens) AS output_tokens,
  sum(input_tokens + cached_read_tokens) AS prompt_tokens FROM us0 GROUP BY ALL) t LEFT JOIN rates r ON r.model = t.norm
  GROUP BY trace_id""", EVENTS, PRICED))
def priced_per_model(spark, sf):
    cost = U.session_cost_on_model_totals(D.usage_rows(spark, sf), rate_table(spark))
    return cost.select("trace_id", money(F.col("cost_usd")).alias("cost_usd"))


@query(q("SELECT trace_id, round(max(context_pct), 6) AS context_window_pct FROM us GROUP BY trace_id", EVENTS, PRICED))
def context_pct(spark, sf):
    return D.priced_rows(spark, sf).groupBy("trace_id").agg(F.round(F.max("context_pct"), 6).alias("context_window_pct"))


@query(q("""SELECT trace_id, rank, model, tokens, percent FROM (SELECT *, row_number() OVER (PARTITION BY trace_id
  ORDER BY tokens DESC, model) AS rank, round(tokens / sum(tokens) OVER (PARTITION BY trace_id) * 100, 6) AS percent
  FROM (SELECT trace_id, 'model_' || k % 5 AS model, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM us GROUP BY ALL)
  WHERE tokens > 0) WHERE rank <= 3""", EVENTS, PRICED))
def model_shares(spark, sf):
    rows = D.usage_rows(spark, sf).withColumn("model", F.concat(F.lit("model_"), F.col("k") % 5))
    return U.model_shares(rows).withColumn("percent", F.round("percent", 6))


@query(q("""SELECT trace_id, seq AS row_no, CASE WHEN raw_type = 'signup' OR m IS NULL THEN coalesce(m, '') ELSE m END
  AS cur_model, CAST(greatest(cum - coalesce(lag(cum) OVER (PARTITION BY trace_id ORDER BY seq), 0), 0) AS BIGINT) AS delta
  FROM (SELECT *, last_value(CASE WHEN raw_type = 'signup' THEN 'model_' || k % 5 END IGNORE NULLS) OVER (PARTITION BY
  trace_id ORDER BY seq) AS m, input_tokens + CASE WHEN k % 7 = 0 THEN 0 ELSE 50 END * index AS cum FROM ev)""", EVENTS))
def cumulative_delta(spark, sf):
    e = D.indexed(spark, sf)
    cum = F.col("input_tokens") + F.when(F.col("k") % 7 == 0, 0).otherwise(50) * F.col("index")
    named = F.when(F.col("raw_type") == "signup", F.concat(F.lit("model_"), F.col("k") % 5))
    out = running(e.withColumn("cum", cum), ["trace_id"], "index",
                  {"cur": ("last", named), "prev": ("lag", F.col("cum"))})
    delta = F.greatest(F.col("cum") - F.coalesce("prev", F.lit(0)), F.lit(0))
    return out.select("trace_id", F.col("seq").alias("row_no"), F.coalesce("cur", F.lit("")).alias("cur_model"),
                      delta.cast("bigint").alias("delta"))


@query(q("""SELECT trace_id, seq AS row_no, ts_ms, agent, model, input_tokens, cached_read_tokens, output_tokens,
  total_tokens, CAST(coalesce(embedded_cost, cost_usd, 0) AS DOUBLE) AS cost_usd FROM us WHERE ts_ms > 0""",
         EVENTS, PRICED))
def usage_points(spark, sf):
    return U.usage_points(D.priced_rows(spark, sf)).select(
        "trace_id", "row_no", "ts_ms", "agent", "model", "input_tokens", "cached_read_tokens", "output_tokens",
        "total_tokens", money(F.col("cost_usd")).alias("cost_usd"))


@query(q("""SELECT trace_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT)
  AS output_tokens, count(*) AS rows FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, key ORDER BY seq) AS rn
  FROM (SELECT *, CASE WHEN k % 5 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS key FROM ev)) WHERE rn = 1 OR key = ''
  GROUP BY trace_id""", EVENTS))
def dedup_usage(spark, sf):
    key = F.when(F.col("k") % 5 == 0, "").otherwise(F.col("k").cast("string"))
    one = U.first_per_key(D.usage_rows(spark, sf).withColumn("key", key), "key")
    return one.groupBy("trace_id").agg(F.sum("input_tokens").alias("input_tokens"),
                                       F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("rows"))


@query(q("""SELECT trace_id, CAST(coalesce(sum(input_tokens) FILTER (WHERE has_tokens), 0) AS BIGINT) AS input_tokens FROM (SELECT *,
  k % 2 = 0 AS has_tokens, row_number() OVER (PARTITION BY trace_id, k ORDER BY seq) AS rn FROM (SELECT * REPLACE
  (k % 20 AS k), k AS k0 FROM ev)) WHERE rn = 1 GROUP BY trace_id""".replace("k % 2 = 0", "k0 % 3 > 0"), EVENTS))
def dedup_before_tokens(spark, sf):
    rows = D.usage_rows(spark, sf).withColumn("key", (F.col("k") % 20).cast("string")).withColumn(
        "has_tokens", F.col("k") % 3 > 0)
    one = U.first_per_key(rows, "key")
    return one.groupBy("trace_id").agg(
        F.sum(F.when(F.col("has_tokens"), F.col("input_tokens")).otherwise(0)).alias("input_tokens"))


@query(q("""SELECT trace_id, CAST(sum(t) AS BIGINT) AS total_tokens FROM (SELECT trace_id, CASE WHEN k % 2 = 0 AND k > 0 THEN k
  ELSE greatest(input_tokens - 500, 0) + output_tokens END AS t FROM ev) GROUP BY trace_id""",
         EVENTS))
def finalised_totals(spark, sf):
    rows = D.usage_rows(spark, sf).withColumn("given", F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(0))
    total = U.finalised(F.col("given"), U.positive(F.col("input_tokens") - 500), F.col("output_tokens"))
    return rows.groupBy("trace_id").agg(F.sum(total).alias("total_tokens"))


_EST = """est AS (SELECT *, trim(text) AS t FROM {src}), est2 AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE
  greatest(1, CAST(ceil(length(t) / 4) AS BIGINT),
  CAST(ceil(len(regexp_split_to_array(t, '\\s+')) * 0.75) AS BIGINT)) END AS n FROM est)"""


@query(q("SELECT doc_id, CAST(n AS BIGINT) AS tokens FROM est2", _EST.format(
    src="(SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents)")))
def token_estimate(spark, sf):
    from ..functions.text import token_estimate as est
    return D.table(spark, sf, "documents").select("doc_id", est(F.col("text")).alias("tokens"))


@query(q("""SELECT trace_id, CAST(sum(CASE WHEN event_kind = 'user' THEN n ELSE 0 END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN event_kind = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS output_tokens,
  min(model) AS first_model, max(model) AS last_model FROM (SELECT *, coalesce(last_value(nullif(event_model, '')
  IGNORE NULLS) OVER w, first_value(nullif(event_model, '') IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY index
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '<unknown>') AS model FROM est2
  WINDOW w AS (PARTITION BY trace_id ORDER BY index)) WHERE n > 0 AND event_kind <> 'system' GROUP BY trace_id""",
         TURNS, _EST.format(src="tu")))
def estimated_usage(spark, sf):
    return U.estimated_usage(D.turns(spark, sf)).groupBy("trace_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.min("model").alias("first_model"), F.max("model").alias("last_model"))


_WAIT = f"""pw AS (SELECT trace_id, NOT arg_max(event_kind IN ('user', 'tool_use', 'tool_result'), seq) AS pending_wait
  FROM ev WHERE event_kind IN ('user', 'tool_use', 'tool_result') OR preview = '{D.WAIT_TEXT}' GROUP BY trace_id)"""


def _wait_events(spark, sf):
    e = D.events(spark, sf)
    return e.withColumns({"text_blocks": F.array("preview"), "tool_args_text": F.lit(""),
                          "tool_result_text": F.lit(""),
                          "raw_json": F.to_json(F.struct(F.col("raw_type").alias("type"), "preview"))})


@query(q("SELECT trace_id, pending_wait FROM pw", EVENTS, _WAIT))
def pending_wait(spark, sf):
    return S.pending_wait(S.with_wait_flag(_wait_events(spark, sf)))


# the clock of the status queries: late enough that most sessions are idle, early enough that some are not
STATUS_NOW_MS = 1_706_572_800_000
STATUS = StatusParams(running_ttl_ms=1_800_000, waiting_ttl_ms=7_200_000)
_LADDER = f"""um AS (SELECT trace_id, count(*) FILTER (WHERE u AND NOT r) AS unmatched FROM (SELECT trace_id, tool_use_id,
  bool_or(event_kind = 'tool_use') AS u, bool_or(event_kind = 'tool_result') AS r FROM ev WHERE tool_use_id <> ''
  GROUP BY ALL) GROUP BY trace_id),
lad AS (SELECT trace_id, CASE WHEN pending_wait THEN CASE WHEN age <= 7200000 THEN 'waiting_input:explicit_wait_marker_fresh'
  ELSE 'idle:stale_timeout' END WHEN unmatched > 0 THEN CASE WHEN age <= 7200000 THEN 'running:pending_tool_use_fresh'
  ELSE 'idle:stale_timeout' END WHEN age <= 1800000 THEN 'running:recent_activity_fresh' WHEN age <= 7200000 THEN
  'waiting_input:recent_activity_cooling' ELSE 'idle:no_active_signal' END AS st FROM (SELECT trace_id,
  coalesce(pending_wait, false) AS pending_wait, coalesce(unmatched, 0) AS unmatched,
  greatest({STATUS_NOW_MS} - (mtime_ms - 86400000), 0) AS age FROM sess LEFT JOIN pw USING (trace_id)
  LEFT JOIN um USING (trace_id)))"""


def _with_status(spark, sf):
    e = _wait_events(spark, sf)
    s = (D.sessions(spark, sf).join(S.unmatched_tools(e), "trace_id", "left")
         .join(S.pending_wait(S.with_wait_flag(e)), "trace_id", "left")
         .fillna(0, ["unmatched_tool_uses"]).fillna(False, ["pending_wait"]))
    st = S.status_ladder(F.col("pending_wait"), F.col("unmatched_tool_uses"), F.col("mtime_ms") - 86_400_000,
                         F.lit(STATUS_NOW_MS), STATUS)
    return s.withColumn("st", st).withColumns({"activity_status": F.col("st.status"), "activity_reason": F.col("st.reason")})


@query(q("""SELECT trace_id, split_part(st, ':', 1) AS activity_status, split_part(st, ':', 2) AS activity_reason FROM lad""",
         EVENTS, SESS, _WAIT, _LADDER))
def status_ladder(spark, sf):
    return _with_status(spark, sf).select("trace_id", "activity_status", "activity_reason")


@query(q("""SELECT status, coalesce(n, 0) AS sessions, round(coalesce(n, 0) / (SELECT count(*) FROM lad) * 100, 2)
  AS share_pct FROM (SELECT unnest(['running', 'waiting_input', 'idle']) AS status) LEFT JOIN
  (SELECT split_part(st, ':', 1) AS status, count(*) AS n FROM lad GROUP BY 1) USING (status)""",
         EVENTS, SESS, _WAIT, _LADDER))
def status_counts(spark, sf):
    return S.status_counts(_with_status(spark, sf))


@query(q("""SELECT trace_id, CASE WHEN s = 'idle' THEN st WHEN age > 7200000 THEN 'idle:stale_timeout' WHEN unmatched > 0
  THEN 'running:pending_tool_use_fresh' WHEN s = 'running' AND age > 1800000 THEN 'waiting_input:recent_activity_cooling'
  ELSE st END AS aged FROM (SELECT lad.trace_id, st, split_part(st, ':', 1) AS s, coalesce(unmatched, 0) AS unmatched,
  """ + str(STATUS_NOW_MS + 5_400_000) + """ - (mtime_ms - 86400000) AS age FROM lad JOIN sess USING (trace_id)
  LEFT JOIN um USING (trace_id))""", EVENTS, SESS, _WAIT, _LADDER))
def status_aging(spark, sf):
    s = _with_status(spark, sf)
    aged = S.aged_status(F.col("activity_status"), F.col("activity_reason"), F.col("unmatched_tool_uses"),
                         F.col("mtime_ms") - 86_400_000, F.lit(STATUS_NOW_MS + 5_400_000), STATUS)
    return s.withColumn("a", aged).select("trace_id", F.concat_ws(":", "a.status", "a.reason").alias("aged"))


@query(q("""SELECT agent, count(DISTINCT sess.trace_id) AS sessions, CAST(sum(event_count) AS BIGINT) AS events,
  CAST(sum(error_count) AS BIGINT) AS errors, round(sum(active_ms) / 3600000, 6) AS session_hours,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost) AS DOUBLE) AS cost_usd FROM sess
  LEFT JOIN (SELECT trace_id, sum(end_ms - start_ms) AS active_ms FROM seg GROUP BY trace_id) USING (trace_id)
  LEFT JOIN (SELECT trace_id, sum(output_tokens) AS output_tokens, sum(coalesce(cost_usd, 0)) AS cost FROM us
  GROUP BY trace_id) USING (trace_id) GROUP BY agent""", EVENTS, SESS, SEG, PRICED))
def fleet_report(spark, sf):
    """Per agent: sessions, events, errors, active hours, output tokens and cost."""
    cost = D.points(spark, sf).groupBy("trace_id").agg(F.sum("output_tokens").alias("output_tokens"),
                                                       F.sum("cost_usd").alias("cost"))
    active = segment_stats(active_segments(D.events(spark, sf))).select("trace_id", "active_ms")
    s = D.sessions(spark, sf).join(active, "trace_id", "left").join(cost, "trace_id", "left")
    return s.groupBy("agent").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("event_count").alias("events"), F.sum("error_count").alias("errors"),
        F.round(F.sum("active_ms") / 3_600_000, 6).alias("session_hours"), F.sum("output_tokens").alias("output_tokens"),
        money(F.sum("cost")).alias("cost_usd"))
