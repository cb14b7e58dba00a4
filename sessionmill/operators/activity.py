"""Day, week and year activity (AG20-AG28, AG36-AG42, JN08, JN09, WF06, WF08, WF12, WF14).

All windows of a report are computed in one job: a timestamp's day and bin follow from arithmetic on the plan's first
window start, so no range join is needed. Everything is folded per (session, day, bin) before it meets another table.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import times
from ..params import WindowPlan, year_range
from ..schemas import AGENT_KINDS, DAY_MS, EVENT_KINDS, HOUR_MS, MINUTE_MS
from .ordered import running
from .usage_rows import positive


def _day_start(plan: WindowPlan, day: Column) -> Column:
    return F.lit(plan.first_start_ms) + day.cast("bigint") * DAY_MS


def _day_end(plan: WindowPlan, day: Column) -> Column:
    start, full = _day_start(plan, day), _day_start(plan, day) + plan.window_ms
    return F.when(day == plan.today_index, F.greatest(start, F.least(full, F.lit(plan.now_ms)))).otherwise(full)


def day_windows(spark: SparkSession, plan: WindowPlan) -> DataFrame:
    """One row per day window of the plan."""
    d = F.col("day")
    df = spark.range(plan.day_count).select(F.col("id").cast("int").alias("day"))
    date = F.date_format(F.date_add(F.lit(plan.start_date), d), "yyyy-MM-dd")
    return df.select("day", date.alias("date_local"), _day_start(plan, d).alias("window_start_ms"),
                     _day_end(plan, d).alias("window_end_ms"))


def dense_bins(spark: SparkSession, plan: WindowPlan) -> DataFrame:
    """Every bin of every day window; the last one may be short."""
    w = day_windows(spark, plan)
    n = F.ceil((F.col("window_end_ms") - F.col("window_start_ms")) / plan.bin_ms).cast("int")
    bins = w.filter(n > 0).withColumn("bin", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("window_start_ms") + F.col("bin") * F.lit(plan.bin_ms)
    return bins.select("day", "date_local", "bin", start.alias("start_ms"),
                       F.least(start + plan.bin_ms, F.col("window_end_ms")).alias("end_ms"))


def session_spans(sessions: DataFrame) -> DataFrame:
    """(trace_id, agent, updated_ms, span_start, span_end) with the span's bounds in time order."""
    a = F.coalesce("first_ts_ms", "last_ts_ms", "mtime_ms")
    b = F.coalesce("last_ts_ms", "mtime_ms")
    updated = F.greatest(F.coalesce("last_ts_ms", F.lit(0)), F.coalesce("mtime_ms", F.lit(0)))
    return sessions.select("trace_id", "agent", updated.alias("updated_ms"), F.least(a, b).alias("span_start"),
                           F.greatest(a, b).alias("span_end"))


def overlaps(plan: WindowPlan, day: Column) -> Column:
    """The session's span touches the day window (FI08)."""
    return (F.col("span_end") >= _day_start(plan, day)) & (F.col("span_start") < _day_end(plan, day))


def in_windows(df: DataFrame, plan: WindowPlan, ts: str = "ts_ms") -> DataFrame:
    """Rows whose timestamp lies in one of the plan's windows, with their day number (FI09, JN10)."""
    t = F.col(ts)
    day = F.floor((t - plan.first_start_ms) / DAY_MS).cast("int")
    last = plan.first_start_ms + plan.day_count * DAY_MS
    return (df.filter((t >= plan.first_start_ms) & (t < last)).withColumn("day", day)
            .filter(t < _day_end(plan, F.col("day"))))


def _binned(df: DataFrame, plan: WindowPlan) -> DataFrame:
    return in_windows(df, plan).withColumn(
        "bin", F.floor((F.col("ts_ms") - _day_start(plan, F.col("day"))) / plan.bin_ms).cast("int"))


def segment_days(segments: DataFrame, plan: WindowPlan) -> DataFrame:
    """One row per segment and day window touched, with the clamped bounds; a segment's end is inclusive."""
    first, end = plan.first_start_ms, plan.end_ms
    s, e = F.greatest(F.col("start_ms"), F.lit(first)), F.least(F.col("end_ms"), F.lit(end - 1))
    near = segments.filter((F.col("end_ms") >= first) & (F.col("start_ms") < end)).select(
        "trace_id", s.alias("s"), e.alias("e")).filter("e >= s")
    day_of = lambda c: F.floor((F.col(c) - first) / DAY_MS).cast("int")
    days = near.withColumn("day", F.explode(F.sequence(day_of("s"), day_of("e"))))
    lo = F.greatest(F.col("s"), _day_start(plan, F.col("day")))
    hi = F.least(F.col("e"), _day_end(plan, F.col("day")) - 1)
    return days.select("trace_id", "day", lo.alias("lo"), hi.alias("hi")).filter("hi >= lo")


def bin_sessions(segments: DataFrame, sessions: DataFrame, plan: WindowPlan) -> DataFrame:
    """Distinct (day, bin, trace_id) of active sessions, with agent and last update (JN08)."""
    d = segment_days(segments, plan)
    at = lambda c: F.floor((F.col(c) - _day_start(plan, F.col("day"))) / plan.bin_ms).cast("int")
    hit = d.withColumn("bin", F.explode(F.sequence(at("lo"), at("hi")))).select("trace_id", "day", "bin").distinct()
    return hit.join(session_spans(sessions), "trace_id").filter(overlaps(plan, F.col("day")))


def _arg_max(keys: tuple[str, ...], prefix: str) -> Column:
    """Key with the largest count, earlier key on ties, 'none' when all are 0."""
    best = F.array_max(F.array(*[F.struct(F.col(f"{prefix}{k}").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k"))
                                 for i, k in enumerate(keys)]))
    return F.when(best["n"] > 0, best["k"]).otherwise(F.lit("none"))


def break_flags(bins: DataFrame, break_minutes: int) -> DataFrame:
    """Runs of empty bins that last at least ``break_minutes`` are breaks (WF06). A day has at most 1440 bins."""
    w = W.partitionBy("day").orderBy("bin")
    quiet = F.col("active_sessions") == 0
    run = F.sum(F.when(quiet, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    length = F.sum(F.when(quiet, F.col("end_ms") - F.col("start_ms")).otherwise(0)).over(W.partitionBy("day", "run"))
    return bins.withColumn("run", run).withColumn("quiet_ms", length).withColumn(
        "is_break", quiet & (F.col("quiet_ms") >= break_minutes * MINUTE_MS)).drop("run", "quiet_ms")


def activity_bins(events: DataFrame, segments: DataFrame, usage: DataFrame, sessions: DataFrame,
                  plan: WindowPlan) -> DataFrame:
    """Time-bin activity of all days of the plan (AG20). One row per bin; the sessions of a bin stay a relation of
    their own (``bin_sessions``), a bin row never holds an unbounded list."""
    spark = events.sparkSession
    spans = session_spans(sessions)
    act = bin_sessions(segments, sessions, plan)
    active = act.groupBy("day", "bin").agg(
        F.count(F.lit(1)).alias("active_sessions"),
        F.min_by("trace_id", F.struct(-F.col("updated_ms"), F.col("trace_id"))).alias("primary_trace_id"),
        *[F.count_if(F.col("agent") == a).alias(f"agent_{a}") for a in AGENT_KINDS])
    kinds = [F.count_if(F.col("event_kind") == k).alias(f"kind_{k}") for k in EVENT_KINDS]
    per = _binned(events.select("trace_id", "ts_ms", "event_kind"), plan).groupBy("trace_id", "day", "bin").agg(
        F.count(F.lit(1)).alias("event_count"), *kinds)
    ev_cols = ["event_count", *[f"kind_{k}" for k in EVENT_KINDS]]
    ev = per.join(spans, "trace_id").filter(overlaps(plan, F.col("day"))).groupBy("day", "bin").agg(
        *[F.sum(c).alias(c) for c in ev_cols])
    tok = _binned(usage.select("trace_id", "ts_ms", "output_tokens", "cost_usd"), plan).groupBy(
        "trace_id", "day", "bin").agg(F.sum(positive(F.col("output_tokens"))).alias("output_tokens"),
                                      F.sum(positive(F.col("cost_usd"))).alias("total_cost_usd"))
    us = tok.join(spans, "trace_id").filter(overlaps(plan, F.col("day"))).groupBy("day", "bin").agg(
        F.sum("output_tokens").alias("output_tokens"), F.sum("total_cost_usd").alias("total_cost_usd"))
    bins = (dense_bins(spark, plan).join(active, ["day", "bin"], "left").join(ev, ["day", "bin"], "left")
            .join(us, ["day", "bin"], "left"))
    counts = ["active_sessions", *[f"agent_{a}" for a in AGENT_KINDS], *ev_cols, "output_tokens"]
    bins = bins.fillna(0, counts).fillna("", ["primary_trace_id"]).withColumns({
        "total_cost_usd": F.coalesce("total_cost_usd", F.lit(0)).cast("decimal(28,6)"),
        "dominant_agent": _arg_max(AGENT_KINDS, "agent_"), "dominant_event_kind": _arg_max(EVENT_KINDS, "kind_")})
    return break_flags(with_metric(bins, plan.metric, "active_sessions"), plan.break_minutes)


def with_metric(df: DataFrame, metric: str, sessions_column: str) -> DataFrame:
    """Heat-map value by metric; all three measures stay, so a switch needs no recomputation (AG24, AG40)."""
    value = {"sessions": F.col(sessions_column), "output_tokens": F.col("output_tokens"),
             "total_cost_usd": F.col("total_cost_usd")}[metric]
    return df.withColumn("heatmap_value", value.cast("double"))


def peaks(bins: DataFrame) -> DataFrame:
    """Largest bin of each day and the start of the first bin reaching it (AG23)."""
    n = F.col("active_sessions")
    return bins.groupBy("day", "date_local").agg(
        F.max(n).alias("peak_sessions"),
        F.min_by(F.when(n > 0, F.col("start_ms")), F.struct(-n, F.col("start_ms"))).alias("peak_at_ms"))


def activity_days(bins: DataFrame, bin_sessions_df: DataFrame, plan: WindowPlan) -> DataFrame:
    """One row per day: sessions that touched any bin, peak, events, tokens, cost (AG21, AG24-AG26)."""
    spark = bins.sparkSession
    distinct = bin_sessions_df.groupBy("day").agg(F.count_distinct("trace_id").alias("total_sessions"))
    sums = bins.groupBy("day").agg(F.sum("event_count").alias("total_events"),
                                   F.sum("output_tokens").alias("output_tokens"),
                                   F.sum("total_cost_usd").alias("total_cost_usd"))
    out = (day_windows(spark, plan).join(distinct, "day", "left").join(sums, "day", "left")
           .join(peaks(bins).drop("date_local"), "day", "left"))
    out = out.fillna(0, ["total_sessions", "total_events", "output_tokens", "peak_sessions"]).withColumn(
        "total_cost_usd", F.coalesce("total_cost_usd", F.lit(0)))
    return with_metric(out, plan.metric, "total_sessions")


def heat_level(value: Column, largest: Column) -> Column:
    """Level 0-4 of a value against the largest one (AG37)."""
    level = F.least(F.greatest(F.ceil(value / largest * 4), F.lit(1)), F.lit(4))
    return F.when((value > 0) & (largest > 0), level).otherwise(F.lit(0)).cast("int")


def heat_grid(bins: DataFrame, plan: WindowPlan) -> DataFrame:
    """All slots of the nominal window for every day; slots still to come are empty (AG41)."""
    spark = bins.sparkSession
    grid = day_windows(spark, plan).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(plan.nominal_bins - 1))))
    largest = bins.agg(F.coalesce(F.max("heatmap_value"), F.lit(0.0))).scalar()
    b = bins.select("day", F.col("bin").alias("slot"), "active_sessions", "event_count", "heatmap_value",
                    "primary_trace_id")
    start = F.col("window_start_ms") + F.col("slot").cast("bigint") * plan.bin_ms
    out = grid.join(b, ["day", "slot"], "left").fillna(0, ["active_sessions", "event_count", "heatmap_value"]) \
        .fillna("", ["primary_trace_id"])
    return out.select("day", "date_local", "slot", start.alias("start_ms"), "active_sessions", "event_count",
                      "heatmap_value", "primary_trace_id", heat_level(F.col("heatmap_value"), largest).alias("level"))


def timeline_stats(bins: DataFrame) -> DataFrame:
    """Breaks, active and empty bins, most agents in one bin, per day (AG36)."""
    w = W.partitionBy("day").orderBy("bin")
    starts = F.col("is_break") & ~F.coalesce(F.lag("is_break").over(w), F.lit(False))
    agents = sum((F.when(F.col(f"agent_{a}") > 0, 1).otherwise(0) for a in AGENT_KINDS), F.lit(0))
    busy = F.col("active_sessions") > 0
    minutes = (F.col("end_ms") - F.col("start_ms")) / MINUTE_MS
    return bins.withColumn("break_start", starts).withColumn("agents", agents).groupBy("day", "date_local").agg(
        F.count_if("break_start").alias("break_count"),
        F.sum(F.when(F.col("is_break"), minutes).otherwise(0.0)).alias("break_minutes"),
        F.count_if(busy).alias("active_bins"), F.count_if(~busy).alias("inactive_bins"),
        F.max("agents").cast("bigint").alias("peak_active_agents"))


def kind_shares(bins: DataFrame) -> DataFrame:
    """Cumulative share of each present event kind inside its bin, in fixed kind order (AG42)."""
    total = reduce(lambda a, b: a + b, [F.col(f"kind_{k}") for k in EVENT_KINDS])
    upto, parts = F.lit(0).cast("bigint"), []
    for k in EVENT_KINDS:
        n = F.col(f"kind_{k}")
        parts.append(F.struct(F.lit(k).alias("event_kind"), n.alias("n"), (upto / total * 100).alias("start_pct"),
                              ((upto + n) / total * 100).alias("end_pct")))
        upto = upto + n
    return (bins.filter(total > 0).select("day", "date_local", "bin", F.explode(F.array(*parts)).alias("p"))
            .filter("p.n > 0").select("day", "date_local", "bin", "p.event_kind",
                                      F.round("p.start_pct", 2).alias("start_pct"),
                                      F.round("p.end_pct", 2).alias("end_pct")))


def earliest_active_day(sessions: DataFrame, end_date_local: str, tz_offset_min: int = 0,
                        day_count: int = 366) -> DataFrame:
    """First local date in the report range on which a session began (AG28); null when there is none."""
    start, end = year_range(end_date_local, day_count)
    day = times.local_day(F.greatest(F.coalesce("first_ts_ms", F.lit(0)), F.lit(1)), tz_offset_min)
    date = F.date_from_unix_date(day)
    return sessions.agg(F.date_format(F.min(F.when(date.between(F.lit(start), F.lit(end)), date)), "yyyy-MM-dd")
                        .alias("earliest_date"))


def concurrency_sweep(spans: DataFrame) -> DataFrame:
    """Most segments open at once per day and when that was first reached (WF08).

    Boundaries of one millisecond are netted first, ends before starts. The running sum is carried over ten-minute
    chunks, so that a busy day is spread over many tasks.
    """
    ends = spans.select("day", F.explode(F.array(
        F.struct((F.col("lo") * 2 + 1).alias("at"), F.lit(1).alias("delta")),
        F.struct(((F.col("hi") + 1) * 2).alias("at"), F.lit(-1).alias("delta")))).alias("b")).select("day", "b.*")
    steps = ends.groupBy("day", "at").agg(F.sum("delta").alias("delta"))
    run = running(steps, ["day"], "at", {"level": ("sum", F.col("delta"))}, 2 * 10 * MINUTE_MS)
    ms = F.floor(F.col("at") / 2).cast("bigint")
    return run.groupBy("day").agg(F.max("level").alias("peak_sessions"),
                                  F.min_by(ms, F.struct(-F.col("level"), F.col("at"))).alias("peak_at_ms"))


def year_segment_days(segments: DataFrame, sessions: DataFrame, plan: WindowPlan) -> DataFrame:
    """Segment pieces per day of sessions whose span touches the whole range, with the agent (JN09)."""
    spans = session_spans(sessions).filter((F.col("span_end") >= plan.first_start_ms)
                                           & (F.col("span_start") < plan.end_ms)).select("trace_id", "agent")
    return segment_days(segments, plan).join(spans, "trace_id")


def year_days(events: DataFrame, segments: DataFrame, usage: DataFrame, sessions: DataFrame,
              plan: WindowPlan) -> DataFrame:
    """One row per day of a year report (AG27); reads timestamps, segments and usage points only."""
    spark = events.sparkSession
    pieces = year_segment_days(segments, sessions, plan)
    spans = session_spans(sessions).filter((F.col("span_end") >= plan.first_start_ms)
                                           & (F.col("span_start") < plan.end_ms)).select("trace_id")
    per = in_windows(events.select("trace_id", "ts_ms"), plan).groupBy("trace_id", "day").agg(F.count(F.lit(1)).alias("n"))
    ev = per.join(spans, "trace_id", "left_semi").groupBy("day").agg(F.sum("n").alias("total_events"))
    us = in_windows(usage, plan).groupBy("day").agg(F.sum(positive(F.col("output_tokens"))).alias("output_tokens"),
                                                    F.sum(positive(F.col("cost_usd"))).alias("total_cost_usd"))
    ids = pieces.groupBy("day").agg(F.count_distinct("trace_id").alias("total_sessions"))
    out = (day_windows(spark, plan).join(ids, "day", "left").join(concurrency_sweep(pieces), "day", "left")
           .join(ev, "day", "left").join(us, "day", "left"))
    out = out.fillna(0, ["total_sessions", "total_events", "output_tokens", "peak_sessions"]).withColumn(
        "total_cost_usd", F.coalesce("total_cost_usd", F.lit(0)))
    return with_metric(out, plan.metric, "total_sessions")


def calendar_grid(days: DataFrame, plan: WindowPlan) -> DataFrame:
    """Week column and weekday row of each day, heat level and month label where a new month starts (AG38, WF14).

    A report has at most 366 days.
    """
    sunday = F.date_sub(F.lit(plan.start_date), (plan.start_date.isoweekday() % 7))
    date = F.to_date("date_local")
    largest = days.agg(F.coalesce(F.max("heatmap_value"), F.lit(0.0))).scalar()
    cells = days.withColumns({"week": F.floor(F.datediff(date, sunday) / 7).cast("int"),
                              "weekday": (F.dayofweek(date) - 1).cast("int"),
                              "level": heat_level(F.col("heatmap_value"), largest)})
    week = W.partitionBy("week").orderBy("date_local")
    cells = cells.withColumn("leads_week", F.row_number().over(week) == 1)
    lead = W.partitionBy("leads_week").orderBy("date_local")
    before = F.lag(F.date_format(date, "MMM")).over(lead)
    month = F.date_format(date, "MMM")
    label = F.when(F.col("leads_week") & (before.isNull() | (before != month)), month).otherwise(F.lit(""))
    return cells.withColumn("month_label", label).drop("leads_week")


def idle_runs(bins: DataFrame, threshold_minutes: int = 240) -> DataFrame:
    """Runs of empty bins with more bins than the threshold spans (WF11)."""
    w = W.partitionBy("day").orderBy("bin")
    quiet = F.col("active_sessions") == 0
    grp = F.sum(F.when(quiet, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    size = bins.withColumn("run", grp).filter(F.col("active_sessions") == 0)
    nominal = F.round(F.max(F.col("end_ms") - F.col("start_ms")) / MINUTE_MS)
    limit = F.greatest(F.lit(1), F.ceil(F.lit(threshold_minutes) / F.greatest(nominal, F.lit(1))))
    return (size.groupBy("day", "date_local", "run")
            .agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count(F.lit(1)).alias("bins"),
                 limit.alias("lim")).filter("bins > lim").select("day", "date_local", "first_bin", "last_bin", "bins"))


def session_bars(bin_sessions_df: DataFrame) -> DataFrame:
    """Runs of neighbouring active bins per session (WF09). A session has at most 1440 bins per day."""
    w = W.partitionBy("day", "trace_id").orderBy("bin")
    island = F.col("bin") - F.row_number().over(w)
    return (bin_sessions_df.withColumn("island", island).groupBy("day", "trace_id", "agent", "island")
            .agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin")).drop("island"))
