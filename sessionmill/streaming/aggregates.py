"""Summaries, segments and activity bins kept current over event streams (SS05-SS07, SS15)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import sessions as S
from ..operators.segments import IDLE_GAP_MS
from .stores import BUCKETS, BinStore, SegmentStore, folder_names

WATERMARK = "24 hours"


def file_events(spark: SparkSession, directory: str, schema, glob: str | None = None, max_files: int = 1000) -> DataFrame:
    """Stream over the files of an event table."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(directory)


def with_event_time(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Events with a positive timestamp, as event time with a watermark."""
    return events.filter("ts_ms > 0").withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def session_summaries(events: DataFrame) -> DataFrame:
    """Running counts and file-order bounds per session; all of them fold associatively (update or complete mode)."""
    return events.groupBy("trace_id").agg(*S.count_measures(), *S.file_order_bounds())


def active_segments(events: DataFrame, gap_ms: int = IDLE_GAP_MS) -> DataFrame:
    """Segments as session windows. A window ends a gap after the last event; the segment ends with the event.

    Append or complete mode only, Spark allows no updates of session windows.
    """
    w = F.session_window("ts", f"{gap_ms} milliseconds")
    return events.groupBy("trace_id", w).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"),
                                             F.count(F.lit(1)).alias("n_events")).drop("session_window")


def activity_bins(events: DataFrame, bin_minutes: int = 5, start_hour: int = 7) -> DataFrame:
    """Exact sessions and events per bin and agent (append mode): events fold per session and bin first.

    Bins start at the local day start, which matters for bin lengths that do not divide an hour.
    """
    return _binned(events, bin_minutes, start_hour).groupBy(F.col("window"), "agent").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events")).select(
        F.unix_millis("window.start").alias("start_ms"), "agent", "sessions", "events")


def _binned(events: DataFrame, bin_minutes: int, start_hour: int) -> DataFrame:
    w = F.window("ts", f"{bin_minutes} minutes", startTime=f"{start_hour * 60 % bin_minutes} minutes")
    return events.groupBy(w, "agent", "trace_id").agg(F.count(F.lit(1)).alias("n"))


def bin_members(events: DataFrame, bin_minutes: int = 5, start_hour: int = 7) -> DataFrame:
    """Events per bin, agent and session, the rows that ``stores.BinStore`` keeps (append mode)."""
    return _binned(events, bin_minutes, start_hour).select(F.unix_millis("window.start").alias("start_ms"), "agent", "trace_id", "n")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything that is there and gives what it wrote; checkpoint and output lie below ``path``."""
    out, state = f"{path}/out", f"{path}/state"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out)
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    q = q.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


class LateSplitter:
    """``foreachBatch`` sink that lays rows older than the newest seen time minus the delay aside (SS15).

    The streamed aggregates drop such rows; the nightly repair folds them in again with ``with_late_rows``. The newest
    time of each batch is one stored row, so a restarted or repeated batch decides as before.
    """

    def __init__(self, spark: SparkSession, root: str, delay_ms: int = 86_400_000):
        self.spark, self.root, self.delay_ms = spark, root.rstrip("/"), delay_ms
        spark.createDataFrame([(-1, None)], "batch bigint, newest_ms bigint").coalesce(1).write.mode("append").parquet(f"{self.root}/marks")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        seen = self.spark.read.parquet(f"{self.root}/marks").filter(F.col("batch") < batch_id)
        limit = seen.agg(F.coalesce(F.max("newest_ms"), F.lit(0)) - self.delay_ms).scalar()
        tagged = batch.withColumn("__late", F.coalesce(F.col("ts_ms") < limit, F.lit(False)))
        for part, want in (("late", True), ("on_time", False)):
            tagged.filter(F.col("__late") == want).drop("__late").write.mode("overwrite").parquet(f"{self.root}/{part}/batch={batch_id}")
        batch.agg(F.lit(batch_id).cast("bigint").alias("batch"), F.max("ts_ms").alias("newest_ms")).write.mode("append").parquet(
            f"{self.root}/marks")


class Repaired:
    """On-time aggregates by streams, and late rows folded into what they stored (SS15).

    ``advance(source)`` takes what the source has new: the splitter lays late rows aside; the aggregates read the on-time rows, all of a
    splitter's batch in one batch of theirs, so their watermark drops none; what they closed and the late rows are then
    added to the stores, which rewrite only the partitions these touch. A call that is repeated adds nothing twice.
    """

    def __init__(self, spark: SparkSession, root: str, schema, delay_ms: int = 86_400_000, bin_minutes: int = 5, kept: tuple[str, ...] = ("segments", "bins"),
                 buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.bin_minutes, self.kept = spark, root.rstrip("/"), schema, bin_minutes, kept
        self.split = LateSplitter(spark, f"{self.root}/rows", delay_ms)
        self.delay = f"{delay_ms} milliseconds"
        self.segments, self.bins = SegmentStore(spark, f"{self.root}/segments", buckets=buckets), BinStore(spark, f"{self.root}/bins")

    def _drain(self, stream: DataFrame, name: str, sink) -> None:
        (stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{self.root}/state-{name}")
         .trigger(availableNow=True).start().awaitTermination())

    def _add(self, store: SegmentStore | BinStore, folder: str, late: bool) -> None:
        """Add the batches of a folder that the store has not had: closed ones are even runs, late ones odd."""
        done = store.store.runs()
        for n in sorted(int(b.removeprefix("batch=")) for b in folder_names(self.spark, f"{self.root}/{folder}") if b.startswith("batch=")):
            if 2 * n + late not in done:
                rows = self.spark.read.parquet(f"{self.root}/{folder}/batch={n}")
                if not late:
                    store.add(2 * n, rows)
                elif store is self.bins:
                    store.add_events(2 * n + 1, rows, self.bin_minutes)
                else:
                    store.add_events(2 * n + 1, rows)

    def advance(self, source: DataFrame) -> None:
        self._drain(source, "split", self.split)
        timed = lambda: with_event_time(self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(
            f"{self.root}/rows/on_time"), self.delay)
        into = lambda name: (lambda df, i: df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={i}"))
        for name in self.kept:
            store = self.segments if name == "segments" else self.bins
            self._drain(active_segments(timed()) if name == "segments" else bin_members(timed(), self.bin_minutes), name, into(f"closed-{name}"))
            self._add(store, f"closed-{name}", False)
            self._add(store, "rows/late", True)


def with_late_rows(spark: SparkSession, root: str) -> DataFrame:
    """On-time and late rows together, for the batch repair."""
    read = lambda part: spark.read.option("basePath", f"{root}/{part}").parquet(f"{root}/{part}").drop("batch")
    return read("on_time").unionByName(read("late"))
