"""Change feed of sessions, following, and status aging (SS03, SS04, SS08-SS14)."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import variants as V
from ..operators import sets as T
from ..operators.browse import timeline
from ..params import StatusParams

STAMPED = ("event_count", "mtime_ms", "last_ts_ms", "cost_usd", "context_window_pct", "input_tokens", "cached_read_tokens",
           "cached_create_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
VERSIONS_PER_BATCH = 1 << 32


def stamped(sessions: DataFrame) -> DataFrame:
    """Sessions with a fingerprint of what viewers see; equal fingerprints need no new delta (SS14)."""
    return sessions.withColumn("stamp", T.stamp([c for c in STAMPED if c in sessions.columns]))


def is_newer(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """The left summary is newer: by file time, then by events."""
    return (left["mtime_ms"] > right["mtime_ms"]) | ((left["mtime_ms"] == right["mtime_ms"])
                                                     & (left["event_count"] > right["event_count"]))


def batch_deltas(before: DataFrame, now: DataFrame, new_events: DataFrame, batch_id: int) -> DataFrame:
    """Deltas of one micro-batch with rising versions (SS10).

    ``before``/``now``: stamped sessions; ``new_events``: trace_id, event_id, index of the events just appended. The
    newest events of a delta are a bounded list. Versions need no global order inside the batch: they are numbered per
    session hash bucket, which keeps them unique and rising over the batches.
    """
    traces = T.session_deltas(before, now).withColumns({"appended": F.lit(None).cast("bigint"), "latest": F.array().cast("array<string>")})
    counts = new_events.groupBy("trace_id").agg(F.count(F.lit(1)).alias("appended"))
    from ..operators.ordered import ranked
    tail = ranked(new_events, ["trace_id"], [F.desc("index")], "back", T.LATEST_EVENTS)
    latest = tail.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("index", "event_id"))).alias("l")).select(
        "trace_id", F.transform("l", lambda x: x["event_id"]).alias("latest"))
    appended = counts.join(latest, "trace_id").select("trace_id", F.lit("events_appended").alias("type"), "appended", "latest")
    both = traces.unionByName(appended)
    bucket = F.pmod(F.xxhash64("trace_id"), F.lit(4096))
    place = F.row_number().over(W.partitionBy(bucket).orderBy("trace_id", F.desc("type")))
    version = F.lit(batch_id * VERSIONS_PER_BATCH) + place * 4096 + bucket
    numbered = both.withColumn("version", version)
    change = traces.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit("").alias("trace_id"), F.lit("overview_updated").alias("type"), F.lit(None).cast("bigint").alias("appended"),
        F.array().cast("array<string>").alias("latest"), F.lit((batch_id + 1) * VERSIONS_PER_BATCH - 1).alias("version"))
    return numbered.unionByName(change)


class DeltaSink:
    """``foreachBatch`` sink: summarises the batch's sessions anew, compares with the stored ones, writes the deltas.

    ``summarise(events) -> sessions``. Only sessions with new events are summarised, over all their events.
    """

    def __init__(self, spark: SparkSession, root: str, summarise):
        self.spark, self.root, self.summarise = spark, root.rstrip("/"), summarise

    def _read(self, part: str, before: int) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.option("basePath", f"{self.root}/{part}").parquet(f"{self.root}/{part}").filter(F.col("batch") < before)

    def _live(self, part: str, before: int) -> DataFrame | None:
        """Rows written before a batch, without those of sessions that were reset since."""
        rows, resets = self._read(part, before), self._read("resets", before)
        if rows is None or resets is None:
            return rows
        last = resets.groupBy("trace_id").agg(F.max("batch").alias("__reset"))
        return rows.join(last, "trace_id", "left").filter(F.col("__reset").isNull() | (F.col("batch") > F.col("__reset"))).drop("__reset")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/events/batch={batch_id}")
        events = self._live("events", batch_id + 1).drop("batch")
        touched = batch.select("trace_id").distinct()
        now = stamped(self.summarise(events.join(touched, "trace_id", "left_semi")))
        now.write.mode("overwrite").parquet(f"{self.root}/sessions/batch={batch_id}")
        now = self.spark.read.schema(now.schema).parquet(f"{self.root}/sessions/batch={batch_id}")
        log = self._live("sessions", batch_id)
        if log is None:
            before = now.filter(F.lit(False)).select("trace_id", "stamp")
        else:
            before = log.groupBy("trace_id").agg(F.max_by("stamp", "batch").alias("stamp")).join(touched, "trace_id", "left_semi")
        new = batch.select("trace_id", "event_id", "index")
        batch_deltas(before, now.select("trace_id", "stamp"), new, batch_id).write.mode("overwrite").parquet(
            f"{self.root}/deltas/batch={batch_id}")

    def reset(self, actions: DataFrame, batch_id: int) -> None:
        """Forget sessions whose files vanished or were rewritten (``sets.change_actions``), up to and including a batch (SS03).

        Each gets a ``trace_removed`` (SS10). A rewritten file's rows then come as a later batch and give ``trace_added`` again.
        """
        gone = actions.filter(F.col("action").isin("vanished", "rewritten")).select("trace_id").distinct()
        gone.write.mode("overwrite").parquet(f"{self.root}/resets/batch={batch_id}")
        gone = self.spark.read.schema("trace_id string").parquet(f"{self.root}/resets/batch={batch_id}")
        known = self._read("sessions", batch_id + 1)
        known = gone if known is None else gone.join(known.select("trace_id").distinct(), "trace_id", "left_semi")
        bucket = F.pmod(F.xxhash64("trace_id"), F.lit(4096))
        place = F.row_number().over(W.partitionBy(bucket).orderBy("trace_id"))
        # the upper half of the batch's versions: after its own deltas, before the next batch's
        known.select("trace_id", F.lit("trace_removed").alias("type"), F.lit(None).cast("bigint").alias("appended"),
                     F.array().cast("array<string>").alias("latest"),
                     (F.lit(batch_id * VERSIONS_PER_BATCH + VERSIONS_PER_BATCH // 2) + place * 4096 + bucket).alias("version")
                     ).write.mode("overwrite").parquet(f"{self.root}/removals/batch={batch_id}")

    def deltas(self) -> DataFrame:
        out = self.spark.read.option("basePath", f"{self.root}/deltas").parquet(f"{self.root}/deltas")
        removals = self._read("removals", 1 << 30)
        return out if removals is None else out.unionByName(removals)


def follow(deltas: DataFrame, trace_id: str) -> DataFrame:
    """Appended events of one session from the change feed, batch or stream (SS12)."""
    return deltas.filter((F.col("trace_id") == trace_id) & (F.col("type") == "events_appended"))


def append_to_page(page: DataFrame, latest: DataFrame) -> DataFrame:
    """A shown page with newly appended events, each once, in time order (SS13)."""
    return timeline(T.union_first([page, latest]))


def affected_sessions(changed: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Session ids that must be derived again after files of a multi-file source changed (SS04).

    ``changed``: path. Messages and diffs name the session in their path, parts in their content (``parts``: path, v).
    """
    p = F.replace("path", F.lit("\\"), F.lit("/"))
    own = F.coalesce(*[F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")) for pattern in (
        r"/storage/session/(?:.*/)?([^/]+)\.json$", r"/storage/message/([^/]+)/", r"/storage/session_diff/([^/]+)\.json$")])
    ids = changed.select(own.alias("session_id")).filter("session_id IS NOT NULL")
    if parts is not None:
        hit = parts.join(changed.filter(p.contains("/storage/part/")).select("path"), "path", "left_semi")
        ids = ids.unionByName(hit.select(F.trim(V.text(F.col("v"), "$.sessionID")).alias("session_id")).filter("session_id <> ''"))
    return ids.distinct()


AGED = "trace_id string, status string, reason string, at_ms bigint"
AGED_STATE = "status string, reason string, unmatched bigint, updated_ms bigint"


def aging_step(status: str, reason: str, unmatched: int, updated_ms: int, now_ms: int, p: StatusParams) -> tuple[str, str]:
    """One session's status after time has passed (the row form of ``sessions.aged_status``)."""
    age = max(0, now_ms - updated_ms)
    if status == "idle":
        return status, reason
    if updated_ms <= 0 or age > p.waiting_ttl_ms:
        return "idle", "stale_timeout"
    if unmatched > 0:
        return "running", "pending_tool_use_fresh"
    if status == "running" and age > p.running_ttl_ms:
        return "waiting_input", "recent_activity_cooling"
    return status, reason


def aged_statuses(summaries: DataFrame, p: StatusParams = StatusParams()) -> DataFrame:
    """Status stream that also changes without new data: a processing-time timer per session (SS09).

    ``summaries``: trace_id, status, reason, unmatched, updated_ms, one row per change.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        before = state.get if state.exists else None
        row = before
        if not state.hasTimedOut:
            for pdf in batches:
                newest = pdf.loc[pdf["updated_ms"].idxmax()]
                if row is None or newest["updated_ms"] >= row[3]:
                    row = (newest["status"], newest["reason"], int(newest["unmatched"]), int(newest["updated_ms"]))
        status, reason = aging_step(row[0], row[1], row[2], row[3], now, p)
        if status == "idle":
            state.remove()
        else:
            state.update((status, reason, row[2], row[3]))
            ttl = p.running_ttl_ms if status == "running" and not row[2] else p.waiting_ttl_ms
            state.setTimeoutDuration(max(1, row[3] + ttl + 1 - now))
        if before is None or (status, reason) != before[:2]:
            yield pd.DataFrame([(key[0], status, reason, now)], columns=["trace_id", "status", "reason", "at_ms"])

    return summaries.groupBy("trace_id").applyInPandasWithState(step, AGED, AGED_STATE, "update",
                                                                GroupStateTimeout.ProcessingTimeTimeout)
