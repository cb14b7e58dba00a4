"""Usage by agent over a report (AG29-AG32, JN10, JN11, SO08, ST05)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..params import WindowPlan
from ..schemas import AGENT_KINDS, HOUR_MS
from .activity import in_windows, year_segment_days
from .usage_rows import positive


def _known(agent: Column) -> Column:
    return F.when(agent.isin(*AGENT_KINDS), agent).otherwise(F.lit("unknown"))


def _slots(bins: DataFrame) -> DataFrame:
    """(agent, day, n, hours) of the bins in which an agent was active."""
    hours = (F.col("end_ms") - F.col("start_ms")) / HOUR_MS
    per = F.array(*[F.struct(F.lit(a).alias("agent"), F.col(f"agent_{a}").alias("n")) for a in AGENT_KINDS])
    return bins.select("day", hours.alias("hours"), F.explode(per).alias("p")).filter("p.n > 0").select(
        "day", "hours", "p.agent", "p.n")


def _slot_measures(slots: DataFrame) -> DataFrame:
    return slots.groupBy("agent").agg(F.sum(F.col("n") * F.col("hours")).alias("session_hours"),
                                      F.count(F.lit(1)).alias("active_slots"),
                                      F.count_distinct("day").alias("active_days"),
                                      F.max("n").alias("peak_sessions"))


def window_tokens(usage: DataFrame, plan: WindowPlan) -> DataFrame:
    """Tokens per agent of the usage points inside any window, of all sessions."""
    return in_windows(usage, plan).groupBy("agent").agg(
        F.sum(positive(F.col("input_tokens"))).alias("input_tokens"),
        F.sum(positive(F.col("cached_read_tokens")) + positive(F.col("cached_create_tokens"))).alias("cache_tokens"),
        F.sum(positive(F.col("output_tokens"))).alias("output_tokens"))


def _finish(slots: DataFrame, unique: DataFrame, tokens: DataFrame) -> DataFrame:
    out = _slot_measures(slots).join(unique, "agent", "full").join(tokens, "agent", "left")
    out = out.fillna(0, [c for c in out.columns if c != "agent"])
    out = out.filter("session_hours > 0 OR unique_sessions > 0 OR active_slots > 0")
    total = out.agg(F.sum("session_hours")).scalar()
    return out.withColumn("session_share_pct", F.when(total > 0, F.col("session_hours") / total * 100).otherwise(0.0)) \
        .orderBy(F.desc("session_hours"), F.desc("unique_sessions"), F.asc("agent"))


def unique_sessions(bin_sessions: DataFrame) -> DataFrame:
    return bin_sessions.groupBy(_known(F.col("agent")).alias("agent")).agg(
        F.count_distinct("trace_id").alias("unique_sessions"))


def week_usage(bins: DataFrame, bin_sessions: DataFrame, usage: DataFrame, plan: WindowPlan) -> DataFrame:
    """Usage rows of a multi-day report, largest first."""
    return _finish(_slots(bins), unique_sessions(bin_sessions), window_tokens(usage, plan))


def session_total_usage(bins: DataFrame, bin_sessions: DataFrame, session_tokens: DataFrame) -> DataFrame:
    """Variant that counts whole sessions: all tokens of every session that touched the window (AG32)."""
    touched = bin_sessions.select("trace_id", _known(F.col("agent")).alias("agent")).distinct()
    tok = touched.join(session_tokens, "trace_id", "left").groupBy("agent").agg(
        F.sum(positive(F.col("input_tokens"))).alias("input_tokens"),
        F.sum(positive(F.col("cached_read_tokens")) + positive(F.col("cached_create_tokens"))).alias("cache_tokens"),
        F.sum(positive(F.col("output_tokens"))).alias("output_tokens"))
    return _finish(_slots(bins), unique_sessions(bin_sessions), tok)


def year_usage(segments: DataFrame, sessions: DataFrame, usage: DataFrame, plan: WindowPlan) -> DataFrame:
    """Usage rows of a year report: counts segments per full half-hour slot (AG30)."""
    pieces = year_segment_days(segments, sessions, plan)
    start = F.lit(plan.first_start_ms) + F.col("day").cast("bigint") * 86_400_000
    at = lambda c: F.floor((F.col(c) - start) / plan.bin_ms).cast("int")
    slots = (pieces.withColumn("slot", F.explode(F.sequence(at("lo"), at("hi"))))
             .groupBy("day", "slot", _known(F.col("agent")).alias("agent")).agg(F.count(F.lit(1)).alias("n"))
             .withColumn("hours", F.lit(plan.bin_ms / HOUR_MS)))
    return _finish(slots, unique_sessions(pieces), window_tokens(usage, plan))


def usage_totals(rows: DataFrame, unique: DataFrame, peak: DataFrame) -> DataFrame:
    """Totals row of a report (AG31). ``unique``: one column trace_id; ``peak``: column peak_sessions."""
    best = F.min_by("agent", F.struct(-F.col("session_hours"), -F.col("unique_sessions"), F.col("agent")))
    head = rows.agg(F.sum("session_hours").alias("total_session_hours"), best.alias("most_used_agent"))
    return head.select(unique.agg(F.count_distinct("trace_id")).scalar().alias("total_unique_sessions"),
                       "total_session_hours",
                       peak.agg(F.coalesce(F.max("peak_sessions"), F.lit(0))).scalar().alias("peak_all_agents"),
                       "most_used_agent")
