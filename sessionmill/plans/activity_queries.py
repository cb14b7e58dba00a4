"""Queries on day, week and year activity and on usage by agent."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import usage as G
from ..operators.segments import active_segments
from ..params import day_plan, week_plan, year_plan
from ..schemas import AGENT_KINDS
from . import datasets as D
from .oracle import EVENTS, PRICED, SEG, SESS, q, windows
from .registry import query

DAY = day_plan("2024-01-15", now_ms=D.NOW_MS)
WEEK = week_plan("2024-01-21", now_ms=D.NOW_MS, day_count=7, slot_minutes=30, hour_start=7, hour_end=2)
TODAY = week_plan("2024-01-31", now_ms=1_706_695_200_000, day_count=7)  # "today" ends at 10:00
YEAR_START, YEAR_END = dt.date(2024, 1, 1), "2024-01-30"
YEAR = year_plan(YEAR_START, YEAR_END, now_ms=D.NOW_MS)

HOUR = 3_600_000
DAY_SQL = windows(DAY.first_start_ms, 1, 24 * HOUR, 5 * 60_000)
WEEK_SQL = windows(WEEK.first_start_ms, 7, 19 * HOUR, 30 * 60_000)
BASE = (EVENTS, SESS, SEG, PRICED)


class Report:
    """Relations of one report over the event sessions. An ingest stores sessions, segments and usage points as tables;
    the queries derive them from the driver's events in the same plan."""

    def __init__(self, spark, sf, plan):
        self.events, self.sessions = D.events(spark, sf), D.sessions(spark, sf)
        self.points, self.plan = D.points(spark, sf), plan
        self.segments = active_segments(self.events)

    @property
    def bins(self):
        return A.activity_bins(self.events, self.segments, self.points, self.sessions, self.plan)

    @property
    def bin_sessions(self):
        return A.bin_sessions(self.segments, self.sessions, self.plan)


_BIN_COLUMNS = ["day", "date_local", "bin", "start_ms", "end_ms", "active_sessions", "event_count", "output_tokens",
                "primary_trace_id", *[f"agent_{a}" for a in AGENT_KINDS], "kind_assistant", "kind_tool_use"]


def _bins_out(bins):
    return bins.select(*_BIN_COLUMNS, F.round("total_cost_usd", 6).cast("double").alias("total_cost_usd"))


@query(q(f"SELECT {', '.join(_BIN_COLUMNS)}, round(total_cost_usd, 6) AS total_cost_usd FROM bins", *BASE, DAY_SQL))
def day_bins(spark, sf):
    return _bins_out(Report(spark, sf, DAY).bins)


@query(q(f"SELECT {', '.join(_BIN_COLUMNS)}, round(total_cost_usd, 6) AS total_cost_usd FROM bins", *BASE, WEEK_SQL))
def week_bins(spark, sf):
    return _bins_out(Report(spark, sf, WEEK).bins)


# part of every four hours is emptied, so that breaks and idle runs occur in the dense test data
_FEW = "quiet AS (SELECT *, CASE WHEN bin % 48 < 20 THEN 0 ELSE active_sessions END AS n FROM bins)"
_BREAKS = """brk AS (SELECT *, n = 0 AND sum(CASE WHEN n = 0 THEN end_ms - start_ms ELSE 0 END)
  OVER (PARTITION BY day, run) >= 600000 AS is_break FROM (SELECT *, sum(CASE WHEN n = 0 THEN 0 ELSE 1 END)
  OVER (PARTITION BY day ORDER BY bin) AS run FROM quiet))"""


def _quiet(bins):
    """Empties part of every four hours, so that breaks and idle runs occur in the dense test data."""
    return bins.withColumn("active_sessions", F.when(F.col("bin") % 48 < 20, 0).otherwise(F.col("active_sessions")))


@query(q("SELECT day, bin, n AS active_sessions, is_break FROM brk", *BASE, DAY_SQL, _FEW, _BREAKS))
def day_breaks(spark, sf):
    flagged = A.break_flags(_quiet(Report(spark, sf, DAY).bins).drop("is_break"), DAY.break_minutes)
    return flagged.select("day", "bin", "active_sessions", "is_break")


@query(q("""SELECT day, date_local, count(*) FILTER (WHERE is_break AND NOT coalesce(prev, false)) AS break_count,
  sum(CASE WHEN is_break THEN (end_ms - start_ms) / 60000 ELSE 0 END) AS break_minutes,
  count(*) FILTER (WHERE n > 0) AS active_bins, count(*) FILTER (WHERE n = 0) AS inactive_bins,
  CAST(max(""" + " + ".join(f"CAST(agent_{a} > 0 AS INTEGER)" for a in AGENT_KINDS) + """) AS BIGINT) AS peak_active_agents
  FROM (SELECT *, lag(is_break) OVER (PARTITION BY day ORDER BY bin) AS prev FROM brk) GROUP BY ALL""",
         *BASE, DAY_SQL, _FEW, _BREAKS))
def timeline_stats(spark, sf):
    flagged = A.break_flags(_quiet(Report(spark, sf, DAY).bins).drop("is_break"), DAY.break_minutes)
    return A.timeline_stats(flagged)


@query(q("""SELECT day, date_local, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS bins FROM (SELECT *,
  sum(CASE WHEN n = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY bin) AS run FROM quiet) WHERE n = 0
  GROUP BY day, date_local, run HAVING count(*) > 12""", *BASE, DAY_SQL, _FEW))
def idle_runs(spark, sf):
    return A.idle_runs(_quiet(Report(spark, sf, DAY).bins), 60)


_PEAK = """SELECT day, date_local, max(active_sessions) AS peak_sessions,
  arg_min(start_ms, (-active_sessions, start_ms)) FILTER (WHERE active_sessions > 0) AS peak_at_ms FROM bins GROUP BY ALL"""


@query(q(_PEAK, *BASE, DAY_SQL))
def day_peak(spark, sf):
    return A.peaks(Report(spark, sf, DAY).bins)


def _dominant_sql(keys, prefix):
    cases = " ".join(f"WHEN {prefix}{k} = m AND m > 0 THEN '{k}'" for k in keys)
    return f"CASE {cases} ELSE 'none' END"


@query(q(f"""SELECT day, bin, {_dominant_sql(AGENT_KINDS, 'agent_')} AS dominant_agent, CASE WHEN event_count = 0 THEN 'none'
  WHEN kind_assistant = k THEN 'assistant' WHEN kind_user = k THEN 'user' WHEN kind_tool_use = k THEN 'tool_use'
  ELSE 'tool_result' END AS dominant_event_kind FROM (SELECT *,
  greatest({', '.join('agent_' + a for a in AGENT_KINDS)}) AS m,
  greatest(kind_assistant, kind_user, kind_tool_use, kind_tool_result) AS k FROM bins)""", *BASE, DAY_SQL))
def day_dominant(spark, sf):
    return Report(spark, sf, DAY).bins.select("day", "bin", "dominant_agent", "dominant_event_kind")


_WEEK_DAYS = """wd AS (SELECT day, date_local, CAST(sum(event_count) AS BIGINT) AS total_events,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(total_cost_usd), 6) AS total_cost_usd,
  max(active_sessions) AS peak_sessions FROM bins GROUP BY ALL),
wd2 AS (SELECT wd.*, coalesce(n, 0) AS total_sessions FROM wd LEFT JOIN (SELECT day, count(DISTINCT trace_id) AS n
  FROM act GROUP BY day) USING (day))"""


@query(q("SELECT date_local, total_events, output_tokens, total_cost_usd, peak_sessions, total_sessions, "
         "CAST(total_sessions AS DOUBLE) AS heatmap_value FROM wd2", *BASE, WEEK_SQL, _WEEK_DAYS))
def week_days(spark, sf):
    r = Report(spark, sf, WEEK)
    return A.activity_days(r.bins, r.bin_sessions, WEEK).select(
        "date_local", "total_events", "output_tokens", F.round("total_cost_usd", 6).cast("double").alias("total_cost_usd"),
        "peak_sessions", "total_sessions", "heatmap_value")


@query(q("""SELECT date_local, metric, value FROM (SELECT date_local, CAST(total_sessions AS DOUBLE) AS sessions,
  CAST(output_tokens AS DOUBLE) AS output_tokens, total_cost_usd FROM wd2) UNPIVOT (value FOR metric IN
  (sessions, output_tokens, total_cost_usd))""", *BASE, WEEK_SQL, _WEEK_DAYS))
def metric_switch(spark, sf):
    """The same computed report under each of the three metrics."""
    r = Report(spark, sf, WEEK)
    days = A.activity_days(r.bins, r.bin_sessions, WEEK)
    parts = [A.with_metric(days, m, "total_sessions").select("date_local", F.lit(m).alias("metric"),
                                                             F.round("heatmap_value", 6).alias("value"))
             for m in ("sessions", "output_tokens", "total_cost_usd")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_AGENT_ROWS = "slots AS (" + " UNION ALL ".join(
    f"SELECT day, '{a}' AS agent, agent_{a} AS n, (end_ms - start_ms) / 3600000 AS h FROM bins WHERE agent_{a} > 0"
    for a in AGENT_KINDS) + ")"
_USAGE = """wu AS (SELECT agent, session_hours, active_slots, active_days, peak_sessions, unique_sessions,
  coalesce(input_tokens, 0) AS input_tokens, coalesce(cache_tokens, 0) AS cache_tokens,
  coalesce(output_tokens, 0) AS output_tokens, round(session_hours / sum(session_hours) OVER () * 100, 6) AS session_share_pct
  FROM (SELECT agent, sum(n * h) AS session_hours, count(*) AS active_slots, count(DISTINCT day) AS active_days,
  max(n) AS peak_sessions FROM slots GROUP BY agent)
  FULL JOIN (SELECT agent, count(DISTINCT trace_id) AS unique_sessions FROM act GROUP BY agent) USING (agent)
  LEFT JOIN tok USING (agent))"""
_WINDOW_TOKENS = """tok AS (SELECT agent, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(cached_read_tokens) AS BIGINT) AS cache_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM us
  JOIN wins ON ts_ms >= ws AND ts_ms < we GROUP BY agent)"""
_USAGE_COLUMNS = ("agent, round(session_hours, 6) AS session_hours, active_slots, active_days, peak_sessions, "
                  "unique_sessions, input_tokens, cache_tokens, output_tokens, session_share_pct")


def _usage_out(df):
    return df.select("agent", F.round("session_hours", 6).alias("session_hours"), "active_slots", "active_days",
                     "peak_sessions", "unique_sessions", "input_tokens", "cache_tokens", "output_tokens",
                     F.round("session_share_pct", 6).alias("session_share_pct"))


@query(q(f"SELECT {_USAGE_COLUMNS} FROM wu", *BASE, WEEK_SQL, _AGENT_ROWS, _WINDOW_TOKENS, _USAGE))
def week_usage(spark, sf):
    r = Report(spark, sf, WEEK)
    return _usage_out(G.week_usage(r.bins, r.bin_sessions, r.points, WEEK))


@query(q("""SELECT (SELECT count(DISTINCT trace_id) FROM act) AS total_unique_sessions,
  round(sum(session_hours), 6) AS total_session_hours, (SELECT max(active_sessions) FROM bins) AS peak_all_agents,
  arg_min(agent, (-session_hours, -unique_sessions, agent)) AS most_used_agent FROM wu""",
         *BASE, WEEK_SQL, _AGENT_ROWS, _WINDOW_TOKENS, _USAGE))
def week_totals(spark, sf):
    r = Report(spark, sf, WEEK)
    rows = G.week_usage(r.bins, r.bin_sessions, r.points, WEEK)
    peak = r.bins.select(F.col("active_sessions").alias("peak_sessions"))
    return G.usage_totals(rows, r.bin_sessions.select("trace_id"), peak).withColumn(
        "total_session_hours", F.round("total_session_hours", 6))


@query(q("""SELECT agent, row_number() OVER (ORDER BY session_hours DESC, unique_sessions DESC, agent) AS place FROM wu""",
         *BASE, WEEK_SQL, _AGENT_ROWS, _WINDOW_TOKENS, _USAGE))
def usage_order(spark, sf):
    """Place of each agent in the usage table; there are at most seven."""
    from pyspark.sql import Window as W
    r = Report(spark, sf, WEEK)
    w = W.orderBy(F.desc("session_hours"), F.desc("unique_sessions"), F.asc("agent"))
    return G.week_usage(r.bins, r.bin_sessions, r.points, WEEK).select("agent", F.row_number().over(w).cast("bigint").alias("place"))


@query(q("SELECT agent, input_tokens, cache_tokens, output_tokens FROM tok", *BASE, WEEK_SQL, _WINDOW_TOKENS))
def usage_in_windows(spark, sf):
    return G.window_tokens(D.points(spark, sf), WEEK)


@query(q("SELECT agent, count(DISTINCT trace_id) AS unique_sessions FROM act GROUP BY agent", *BASE, WEEK_SQL))
def usage_distinct(spark, sf):
    return G.unique_sessions(Report(spark, sf, WEEK).bin_sessions)


@query(q(f"SELECT {_USAGE_COLUMNS} FROM wu", *BASE, WEEK_SQL, _AGENT_ROWS, """tok AS (SELECT agent,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_read_tokens) AS BIGINT) AS cache_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM us WHERE trace_id IN (SELECT trace_id FROM act) GROUP BY agent)""",
         _USAGE))
def usage_session_totals(spark, sf):
    from ..operators.usage_rows import session_tokens
    r = Report(spark, sf, WEEK)
    return _usage_out(G.session_total_usage(r.bins, r.bin_sessions, session_tokens(D.usage_rows(spark, sf))))


@query(q("""SELECT date_local, CAST((start_ms - ws) // 1800000 AS INTEGER) AS slot, active_sessions,
  CASE WHEN active_sessions > 0 THEN CAST(least(greatest(ceil(active_sessions / max(active_sessions) OVER () * 4), 1), 4)
  AS INTEGER) ELSE 0 END AS level FROM bins JOIN wins USING (day, date_local)""", *BASE, WEEK_SQL))
def heat_levels(spark, sf):
    return A.heat_grid(Report(spark, sf, WEEK).bins, WEEK).select("date_local", "slot", "active_sessions", "level")


_TODAY_SQL = f"""grid2 AS (SELECT CAST(d AS INTEGER) AS day, CAST(s AS INTEGER) AS slot,
  {TODAY.first_start_ms} + d * 86400000 + s * 1800000 AS start_ms FROM range(7) a(d), range(48) b(s))"""


@query(q(f"""SELECT grid2.day, slot, grid2.start_ms, CASE WHEN grid2.start_ms < {TODAY.now_ms} THEN coalesce(event_count, 0)
  ELSE 0 END AS event_count FROM grid2 LEFT JOIN bins ON bins.day = grid2.day AND bins.bin = grid2.slot""",
         *BASE, windows(TODAY.first_start_ms, 7, 24 * HOUR, 30 * 60_000), _TODAY_SQL))
def dense_grid(spark, sf):
    """The last day is today and half over; its remaining slots must be there and empty."""
    return A.heat_grid(Report(spark, sf, TODAY).bins, TODAY).select("day", "slot", "start_ms", "event_count")


_KINDS = ("assistant", "user", "tool_use", "tool_result")
_SHARES = "SELECT day, date_local, bin, event_kind, round(s / event_count * 100, 2) AS start_pct, " \
          "round((s + n) / event_count * 100, 2) AS end_pct FROM (" + " UNION ALL ".join(
    f"SELECT day, date_local, bin, event_count, '{k}' AS event_kind, kind_{k} AS n, "
    + (" + ".join(f"kind_{x}" for x in _KINDS[:i]) or "0") + " AS s FROM bins" for i, k in enumerate(_KINDS)) \
    + ") WHERE n > 0"


@query(q(_SHARES, *BASE, DAY_SQL))
def kind_shares(spark, sf):
    return A.kind_shares(Report(spark, sf, DAY).bins)


@query(q("SELECT day, trace_id, agent, min(bin) AS first_bin, max(bin) AS last_bin FROM (SELECT *, bin - row_number() "
         "OVER (PARTITION BY day, trace_id ORDER BY bin) AS isl FROM act) GROUP BY day, trace_id, agent, isl",
         *BASE, DAY_SQL))
def active_runs(spark, sf):
    return A.session_bars(Report(spark, sf, DAY).bin_sessions)


@query(q("""SELECT strftime(min(d), '%Y-%m-%d') AS earliest_date FROM (SELECT CAST(make_timestamp(first_ts_ms * 1000) AS DATE)
  AS d FROM sess) WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'""", EVENTS, SESS))
def earliest_active(spark, sf):
    return A.earliest_active_day(D.sessions(spark, sf), YEAR_END)


_YEAR_SQL = windows(YEAR.first_start_ms, 30, 24 * HOUR, 30 * 60_000) + f""",
yspan AS (SELECT trace_id, agent FROM span WHERE se >= {YEAR.first_start_ms} AND ss < {YEAR.end_ms}),
yp AS (SELECT day, s.trace_id, agent, greatest(s.start_ms, ws) AS lo, least(s.end_ms, we - 1) AS hi, ws FROM seg s
  JOIN yspan USING (trace_id) JOIN wins ON s.end_ms >= ws AND s.start_ms < we),
marks AS (SELECT day, lo AS mark, 1 AS delta FROM yp UNION ALL SELECT day, hi + 1, -1 FROM yp),
sweep AS (SELECT day, mark, delta, sum(delta) OVER (PARTITION BY day ORDER BY mark, delta
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM marks),
peak AS (SELECT day, CAST(max(level) AS BIGINT) AS peak_sessions, arg_min(mark, (-level, mark)) AS peak_at_ms FROM sweep
  GROUP BY day),
yd AS (SELECT wins.day, date_local, coalesce(total_sessions, 0) AS total_sessions, coalesce(total_events, 0) AS total_events,
  coalesce(output_tokens, 0) AS output_tokens, coalesce(total_cost_usd, 0) AS total_cost_usd,
  coalesce(peak_sessions, 0) AS peak_sessions, peak_at_ms FROM wins
  LEFT JOIN (SELECT day, count(DISTINCT trace_id) AS total_sessions FROM yp GROUP BY day) USING (day)
  LEFT JOIN (SELECT day, count(*) AS total_events FROM ev JOIN yspan USING (trace_id) JOIN wins ON ts_ms >= ws AND ts_ms < we
    GROUP BY day) USING (day)
  LEFT JOIN (SELECT day, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    round(CAST(sum(coalesce(cost_usd, 0)) AS DOUBLE), 6) AS total_cost_usd FROM us JOIN wins ON ts_ms >= ws AND ts_ms < we
    GROUP BY day) USING (day)
  LEFT JOIN peak USING (day))"""


def _year(spark, sf):
    r = Report(spark, sf, YEAR)
    return A.year_days(r.events, r.segments, r.points, r.sessions, YEAR)


@query(q("SELECT date_local, total_sessions, total_events, output_tokens, total_cost_usd, peak_sessions, peak_at_ms FROM yd",
         *BASE, _YEAR_SQL))
def year_days(spark, sf):
    return _year(spark, sf).select("date_local", "total_sessions", "total_events", "output_tokens",
                                   F.round("total_cost_usd", 6).cast("double").alias("total_cost_usd"),
                                   "peak_sessions", "peak_at_ms")


@query(q("SELECT day, peak_sessions, peak_at_ms FROM peak", *BASE, _YEAR_SQL))
def year_peak_sweep(spark, sf):
    r = Report(spark, sf, YEAR)
    return A.concurrency_sweep(A.year_segment_days(r.segments, r.sessions, YEAR))


@query(q(f"SELECT {_USAGE_COLUMNS} FROM wu", *BASE, _YEAR_SQL, """slots AS (SELECT day, agent, count(*) AS n, 0.5 AS h
  FROM yp JOIN range(48) t(b) ON b BETWEEN (lo - ws) // 1800000 AND (hi - ws) // 1800000 GROUP BY day, agent, b)""",
         _WINDOW_TOKENS, _USAGE.replace("FROM act", "FROM yp")))
def year_usage(spark, sf):
    r = Report(spark, sf, YEAR)
    return _usage_out(G.year_usage(r.segments, r.sessions, r.points, YEAR))


_CELLS = """cells AS (SELECT date_local, total_sessions, CAST(floor(datediff('day', DATE '2023-12-31', d) / 7) AS INTEGER)
  AS week, CAST(dayofweek(d) AS INTEGER) AS weekday, CASE WHEN total_sessions > 0 THEN CAST(least(greatest(ceil(total_sessions /
  max(total_sessions) OVER () * 4), 1), 4) AS INTEGER) ELSE 0 END AS level FROM (SELECT *, CAST(date_local AS DATE) AS d
  FROM yd))"""


@query(q("SELECT date_local, week, weekday, level, total_sessions FROM cells", *BASE, _YEAR_SQL, _CELLS))
def calendar_grid(spark, sf):
    return A.calendar_grid(_year(spark, sf), YEAR).select("date_local", "week", "weekday", "level", "total_sessions")


_MARK_PLAN = year_plan(dt.date(2023, 12, 3), "2024-02-24", now_ms=1_709_251_200_000)


@query(q(f"""SELECT date_local, CASE WHEN lead AND (prev IS NULL OR prev <> m) THEN m ELSE '' END AS month_label FROM (
  SELECT *, lag(m) OVER (PARTITION BY lead ORDER BY date_local) AS prev FROM (SELECT date_local,
  strftime(CAST(date_local AS DATE), '%b') AS m, dayofweek(CAST(date_local AS DATE)) = 0 AS lead FROM wins))""",
         *BASE, windows(_MARK_PLAN.first_start_ms, _MARK_PLAN.day_count, 24 * HOUR, 30 * 60_000)))
def month_marks(spark, sf):
    r = Report(spark, sf, _MARK_PLAN)
    days = A.year_days(r.events, r.segments, r.points, r.sessions, _MARK_PLAN)
    return A.calendar_grid(days, _MARK_PLAN).select("date_local", "month_label")
