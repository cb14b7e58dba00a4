"""Active segments: runs of events without a gap above 20 minutes (WF01)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..schemas import HOUR_MS, MINUTE_MS

IDLE_GAP_MS = 20 * MINUTE_MS


def active_segments(events: DataFrame, gap_ms: int = IDLE_GAP_MS) -> DataFrame:
    """(trace_id, seg_no, start_ms, end_ms, n_events) from the positive timestamps of the events.

    Equal milliseconds are folded first. Segments are then built per hour, which leaves at most a few pieces per
    session and hour, and only these pieces are put in order per session. No task ever sees a whole session's events.
    """
    points = (events.filter(F.col("ts_ms") > 0).groupBy("trace_id", "ts_ms").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("hour", F.floor(F.col("ts_ms") / HOUR_MS)))
    w = W.partitionBy("trace_id", "hour").orderBy("ts_ms")
    cut = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w) > gap_ms).cast("int"), F.lit(0))
    pieces = (points.withColumn("cut", cut)
              .withColumn("piece", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
              .groupBy("trace_id", "hour", "piece")
              .agg(F.min("ts_ms").alias("s"), F.max("ts_ms").alias("e"), F.sum("n").alias("n")))
    t = W.partitionBy("trace_id").orderBy("s")
    fresh = F.coalesce((F.col("s") - F.lag("e").over(t) > gap_ms).cast("int"), F.lit(1))
    return (pieces.withColumn("fresh", fresh)
            .withColumn("seg_no", F.sum("fresh").over(t.rowsBetween(W.unboundedPreceding, 0)).cast("bigint"))
            .groupBy("trace_id", "seg_no")
            .agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), F.sum("n").alias("n_events")))


def segment_stats(segments: DataFrame) -> DataFrame:
    span = F.col("end_ms") - F.col("start_ms")
    return segments.groupBy("trace_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("n_events").alias("events"),
                                            F.sum(span).alias("active_ms"), F.max(span).alias("longest_ms"))
