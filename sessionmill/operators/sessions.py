"""Session summaries (AG01-AG07, AG33-AG35, AG39, JN01, JN02, WF04, WF05, WF07, SS08, SS09)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variants as V
from ..functions import waits
from ..params import StatusParams
from ..schemas import EVENT_KINDS, MINUTE_MS, STATUSES
from .ordered import attach_by_chunk, ranked

BINS = 12
TOP_TOOLS = 12


def kind_map() -> Column:
    """Count per event kind, every kind present."""
    return F.create_map(*[x for k in EVENT_KINDS for x in (F.lit(k), F.count_if(F.col("event_kind") == k))])


def count_measures() -> list[Column]:
    kind = F.col("event_kind")
    return [
        F.count(F.lit(1)).alias("event_count"),
        F.count_if("has_error").alias("error_count"),
        F.count_if(kind == "tool_use").alias("tool_use_count"),
        F.count_if(kind == "tool_result").alias("tool_result_count"),
        F.count_if(kind == "compaction").alias("compaction_count"),
        F.max(F.when(kind == "compaction", F.col("ts_ms"))).alias("last_compaction_ts_ms"),
    ]


def file_order_bounds() -> list[Column]:
    """First and last timestamp in file order, which need not be the smallest and the largest."""
    at = F.when(F.col("ts_ms").isNotNull(), F.col("index"))
    return [F.min_by("ts_ms", at).alias("first_ts_ms"), F.max_by("ts_ms", at).alias("last_ts_ms")]


def unmatched_tools(events: DataFrame) -> DataFrame:
    """Distinct tool-use ids without result and result ids without use, per session, in one pass over the ids."""
    ids = (events.filter(F.col("event_kind").isin("tool_use", "tool_result") & (F.col("tool_use_id") != ""))
           .groupBy("trace_id", "tool_use_id")
           .agg(F.bool_or(F.col("event_kind") == "tool_use").alias("used"),
                F.bool_or(F.col("event_kind") == "tool_result").alias("answered")))
    return ids.groupBy("trace_id").agg(F.count_if(F.col("used") & ~F.col("answered")).alias("unmatched_tool_uses"),
                                       F.count_if(~F.col("used") & F.col("answered")).alias("unmatched_tool_results"))


def tool_counts(events: DataFrame) -> DataFrame:
    name = V.first_filled(F.col("tool_name"), F.col("function_name"))
    return (events.filter(F.col("event_kind") == "tool_use").withColumn("name", name).filter("name <> ''")
            .groupBy("trace_id", "name").agg(F.count(F.lit(1)).alias("count")))


def top_tools(events: DataFrame, limit: int = TOP_TOOLS) -> DataFrame:
    """Most used tools of each session, one row per session and tool."""
    return ranked(tool_counts(events), ["trace_id"], [F.desc("count"), F.asc("name")], "rank", limit)


def top_tools_overall(events: DataFrame, limit: int = TOP_TOOLS, exact: bool = False) -> DataFrame:
    """Tools over all sessions. By default sums the sessions' truncated lists; ``exact`` counts every call."""
    rows = tool_counts(events) if exact else top_tools(events)
    return (rows.groupBy("name").agg(F.sum("count").alias("count"))
            .orderBy(F.desc("count"), F.asc("name")).limit(max(1, limit)))


def tool_type_counts(events: DataFrame) -> DataFrame:
    """Calls per tool type; use and result of one call count once."""
    typ, call = F.trim("tool_type"), F.trim("tool_call_id")
    key = F.when(call != "", F.concat_ws(":", typ, call)).otherwise(F.col("event_id"))
    return (events.select(typ.alias("tool_type"), key.alias("k")).filter("tool_type <> ''")
            .groupBy("tool_type").agg(F.count_distinct("k").alias("calls")))


def pending_wait(events: DataFrame) -> DataFrame:
    """Does the latest telling event wait for the user? Needs ``is_wait``; resolutions win over wait texts."""
    resolves = waits.is_resolution(F.col("event_kind"))
    telling = events.filter(resolves | F.col("is_wait"))
    return telling.groupBy("trace_id").agg((~F.max_by(resolves, "index")).alias("pending_wait"))


def with_wait_flag(events: DataFrame) -> DataFrame:
    """Marks events that carry a wait signal; rows that resolve a wait are never tested."""
    c = F.col
    signal = waits.structured_wait_text(c("raw_json"), c("raw_type")) | waits.text_wait(
        c("raw_type"), c("preview"), F.concat_ws(" ", "text_blocks"), c("tool_args_text"), c("tool_result_text"))
    return events.withColumn("is_wait", ~waits.is_resolution(c("event_kind")) & F.coalesce(signal, F.lit(False)))


def _bin_arrays(counts: DataFrame, mode: str) -> DataFrame:
    """12-slot arrays scaled by their maximum from (trace_id, bin, n)."""
    arr = F.array(*[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)).cast("double")
                    for i in range(BINS)])
    return counts.groupBy("trace_id").agg(arr.alias("a")).select(
        "trace_id", F.transform("a", lambda x: x / F.array_max("a")).alias("activity_bins"),
        F.lit(mode).alias("activity_bins_mode"), F.lit(BINS).cast("bigint").alias("activity_bin_count"))


def lifetime_bins(events: DataFrame, stats: DataFrame) -> DataFrame:
    """Activity over a session's life: 12 bins between first and last timestamp in file order, else over event
    positions. ``stats`` has trace_id, event_count and the bounds over positive timestamps (pos_*)."""
    timed = (F.col("timed_count") >= 2) & (F.col("pos_last") > F.col("pos_first"))
    rows = attach_by_chunk(events.select("trace_id", "index", "ts_ms"), stats.withColumn("timed", timed).select(
        "trace_id", "event_count", "timed", "pos_first", "pos_last"), "trace_id", "index", "event_count")
    span = F.col("pos_last") - F.col("pos_first")
    by_time = F.floor((F.col("ts_ms") - F.col("pos_first")) / span * BINS)
    by_index = F.floor((F.col("index") - 1) / F.col("event_count") * BINS)
    raw = F.when(F.col("timed"), by_time).otherwise(by_index)
    counts = (rows.filter(~F.col("timed") | (F.col("ts_ms") > 0))
              .groupBy("trace_id", "timed", F.least(F.greatest(raw, F.lit(0)), F.lit(BINS - 1)).alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    arrays = _bin_arrays(counts.filter("timed"), "time").unionByName(_bin_arrays(counts.filter("NOT timed"), "event_index"))
    minutes = F.when(timed, span / MINUTE_MS)
    meta = stats.select("trace_id", minutes.alias("activity_window_minutes"), (minutes / BINS).alias("activity_bin_minutes"))
    return arrays.join(meta, "trace_id")


def positive_bounds() -> list[Column]:
    at = F.when(F.col("ts_ms") > 0, F.col("index"))
    return [F.count_if(F.col("ts_ms") > 0).alias("timed_count"), F.min_by("ts_ms", at).alias("pos_first"),
            F.max_by("ts_ms", at).alias("pos_last")]


def status_ladder(pending: Column, unmatched: Column, updated_ms: Column, now_ms: Column,
                  p: StatusParams = StatusParams()) -> Column:
    """(status, reason) of a session (SS08). Expiry is strict; open tool calls live as long as a wait does."""
    age = F.greatest(now_ms - updated_ms, F.lit(0))
    state = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    known, run, wait = updated_ms > 0, age <= max(0, p.running_ttl_ms), age <= max(0, p.waiting_ttl_ms)
    stale = state("idle", "stale_timeout")
    return (F.when(pending, F.when(known & wait, state("waiting_input", "explicit_wait_marker_fresh")).otherwise(stale))
            .when(unmatched > 0, F.when(known & wait, state("running", "pending_tool_use_fresh")).otherwise(stale))
            .when(known & run, state("running", "recent_activity_fresh"))
            .when(known & wait, state("waiting_input", "recent_activity_cooling"))
            .otherwise(state("idle", "no_active_signal")))


def aged_status(status: Column, reason: Column, unmatched: Column, updated_ms: Column, now_ms: Column,
                p: StatusParams = StatusParams()) -> Column:
    """Status of a stored session after time has passed without new data (SS09, batch form)."""
    age = F.greatest(now_ms - updated_ms, F.lit(0))
    state = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    same = F.struct(status.alias("status"), reason.alias("reason"))
    return (F.when(status == "idle", same)
            .when((updated_ms <= 0) | (age > p.waiting_ttl_ms), state("idle", "stale_timeout"))
            .when(unmatched > 0, state("running", "pending_tool_use_fresh"))
            .when((status == "running") & (age > p.running_ttl_ms), state("waiting_input", "recent_activity_cooling"))
            .otherwise(same))


def summarize(events: DataFrame, files: DataFrame, now_ms: int, usage: DataFrame | None = None,
              status: StatusParams = StatusParams()) -> DataFrame:
    """One row per log file (AG01). Files without events stay, with their parse error.

    ``files``: trace_id, path, source_profile, agent, parser, session_id, size_bytes, mtime_ms, parse_error.
    """
    events = with_wait_flag(events)
    stats = events.groupBy("trace_id").agg(*count_measures(), kind_map().alias("event_kind_counts"),
                                           *file_order_bounds(), *positive_bounds())
    tools = top_tools(events).groupBy("trace_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "name", "count"))).alias("t")).select(
        "trace_id", F.transform("t", lambda x: F.struct(x["name"], x["count"])).alias("top_tools"))
    out = (files.join(stats, "trace_id", "left").join(unmatched_tools(events), "trace_id", "left")
           .join(pending_wait(events), "trace_id", "left").join(tools, "trace_id", "left")
           .join(lifetime_bins(events, stats), "trace_id", "left"))
    if usage is not None:
        out = out.join(usage, "trace_id", "left")
    zeros = ["event_count", "error_count", "tool_use_count", "tool_result_count", "compaction_count",
             "unmatched_tool_uses", "unmatched_tool_results"]
    out = out.fillna(0, zeros).fillna(False, ["pending_wait"])
    empty_kinds = F.create_map(*[x for k in EVENT_KINDS for x in (F.lit(k), F.lit(0).cast("bigint"))])
    updated = F.greatest(F.coalesce("last_ts_ms", F.lit(0)), F.col("mtime_ms"))
    st = status_ladder(F.col("pending_wait"), F.col("unmatched_tool_uses"), updated, F.lit(now_ms), status)
    return (out.withColumn("event_kind_counts", F.coalesce("event_kind_counts", empty_kinds))
            .withColumn("updated_ms", updated).withColumn("st", st)
            .withColumns({"activity_status": F.col("st.status"), "activity_reason": F.col("st.reason"),
                          "parseable": F.col("parse_error") == ""})
            .drop("st", "timed_count", "pos_first", "pos_last", "pending_wait"))


def overview(sessions: DataFrame) -> DataFrame:
    """Fleet totals. ``session_count`` counts log files with a session id, not distinct ids."""
    return sessions.agg(
        F.count(F.lit(1)).alias("trace_count"), F.count_if(F.col("session_id") != "").alias("session_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("event_count", "error_count", "tool_use_count",
                                                            "tool_result_count")])


def by_agent(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("agent").agg(F.count(F.lit(1)).alias("sessions"), F.sum("event_count").alias("events"))


def by_kind(events: DataFrame) -> DataFrame:
    """Events per kind, absent kinds as 0."""
    spark = events.sparkSession
    kinds = spark.sql("SELECT explode(array(" + ", ".join(f"'{k}'" for k in EVENT_KINDS) + ")) AS event_kind")
    counts = events.groupBy("event_kind").agg(F.count(F.lit(1)).alias("events"))
    return kinds.join(counts, "event_kind", "left").fillna(0, ["events"])


def status_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per status with their share in percent, every status present."""
    spark = sessions.sparkSession
    names = spark.sql("SELECT explode(array(" + ", ".join(f"'{k}'" for k in STATUSES) + ")) AS status")
    n = sessions.groupBy(F.col("activity_status").alias("status")).agg(F.count(F.lit(1)).alias("sessions"))
    total = sessions.agg(F.count(F.lit(1))).scalar()
    return names.join(n, "status", "left").fillna(0, ["sessions"]).withColumn(
        "share_pct", F.when(total > 0, F.round(F.col("sessions") / total * 100, 2)).otherwise(F.lit(0.0)))


def event_mix(events: DataFrame) -> DataFrame:
    """Share of assistant, user, tool_use and tool_result events of each session among these four, in percent."""
    kinds = ("assistant", "user", "tool_use", "tool_result")
    per = events.groupBy("trace_id").agg(*[F.count_if(F.col("event_kind") == k).alias(k) for k in kinds])
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return per.select("trace_id", *[F.when(total > 0, F.round(F.col(k) / total * 100, 2)).otherwise(F.lit(0.0))
                                    .alias(f"{k}_pct") for k in kinds])


def newest_event(sessions: DataFrame) -> DataFrame:
    newest = F.max("last_ts_ms")
    return sessions.agg(F.when(newest > 0, newest).alias("newest_ts_ms"))
