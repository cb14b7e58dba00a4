"""Stored tables of which a run rewrites only the partitions it touches, and the merges of late rows into them (SS06, SS07, SS15)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.segments import IDLE_GAP_MS, active_segments
from ..schemas import HOUR_MS

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), F.lit(buckets)).cast("int")


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


class PartitionStore:
    """A table in partitions by one whole number.

    A run writes the partitions it touches into its own folder and then a manifest that names the run of every partition: the manifest is
    the commit, so readers see all of a run or nothing, a run that failed may be repeated, and one that was done is not done
    again. Partitions and their number (at most a few thousand) are all the driver handles.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, partition: str = "bucket"):
        self.spark, self.root, self.partition = spark, root.rstrip("/"), partition
        self.schema = spark.createDataFrame([], f"{schema}, {partition} int").schema

    def runs(self) -> dict[int, int]:
        """Finished runs and their place in the order of commits."""
        found = [n for n in folder_names(self.spark, f"{self.root}/manifest") if "_SUCCESS" in folder_names(self.spark, f"{self.root}/manifest/{n}")]
        return {int(run): int(place) for place, run in (n.split("-") for n in found)}

    def manifest(self) -> dict[int, int]:
        """The run that wrote each partition last."""
        runs = self.runs()
        if not runs:
            return {}
        newest = max(runs, key=runs.get)
        return {r.part: r.run for r in self.spark.read.schema("part int, run int").parquet(f"{self.root}/manifest/{runs[newest]}-{newest}").collect()}

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The table, or some partitions of it."""
        at = self.manifest()
        paths = [f"{self.root}/data/run={at[p]}/{self.partition}={p}" for p in (at if parts is None else parts) if p in at]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        got = self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data").parquet(*paths)
        return got.select(*self.schema.names)

    def rewrite(self, run: int, touched: list[int], build: Callable[[DataFrame], DataFrame]) -> bool:
        """Replace the touched partitions by ``build(their rows)``; false if the run was done before."""
        runs = self.runs()
        if run in runs:
            return False
        at, target = self.manifest(), f"{self.root}/data/run={run}"
        if touched:
            (build(self.read(touched)).select(*self.schema.names).repartition(F.col(self.partition)).write.mode("overwrite")
             .partitionBy(self.partition).parquet(target))
        written = [int(n.split("=")[1]) for n in folder_names(self.spark, target) if n.startswith(f"{self.partition}=")]
        now = {p: r for p, r in at.items() if p not in set(touched)} | dict.fromkeys(written, run)
        self.spark.createDataFrame(sorted(now.items()), "part int, run int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{len(runs)}-{run}")
        return True

    def vacuum(self) -> int:
        """Remove folders of partitions that newer runs replaced; returns how many. Only while nobody reads older manifests."""
        at, gone = self.manifest(), 0
        for folder in folder_names(self.spark, f"{self.root}/data"):
            for n in folder_names(self.spark, f"{self.root}/data/{folder}"):
                if n.startswith(f"{self.partition}=") and at.get(int(n.split("=")[1])) != int(folder.removeprefix("run=")):
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{folder}/{n}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                    gone += 1
        return gone


def parts_of(rows: DataFrame, partition: Column) -> list[int]:
    """The partitions that rows fall into, at most as many as the store has."""
    return sorted(r[0] for r in rows.select(partition.alias("p")).distinct().collect())


def merged_segments(stored: DataFrame, new: DataFrame, gap_ms: int = IDLE_GAP_MS) -> DataFrame:
    """Segments (trace_id, start_ms, end_ms, n_events) with new ones folded in.

    Only stored segments within the gap of a new one are put in order with it and united; the others are passed on as they are. They
    meet by session and hour, so a session with very many segments is no hot key, and what is ordered is segments, never events.
    """
    hours = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - gap_ms) / HOUR_MS), F.floor((F.col(hi) + gap_ms) / HOUR_MS)))
    cols = ["trace_id", "start_ms", "end_ms", "n_events"]
    near = new.select("trace_id", F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"), hours("start_ms", "end_ms").alias("hour"))
    held = stored.select("trace_id", "start_ms", "end_ms", hours("start_ms", "end_ms").alias("hour"))
    meets = (F.col("start_ms") <= F.col("hi") + gap_ms) & (F.col("end_ms") >= F.col("lo") - gap_ms)
    # stored segments of a session never start together
    hit = held.join(near, ["trace_id", "hour"]).filter(meets).select("trace_id", "start_ms").distinct()
    marked = stored.select(*cols).join(hit.withColumn("hit", F.lit(True)), ["trace_id", "start_ms"], "left")
    w = W.partitionBy("trace_id").orderBy("start_ms", "end_ms")
    loose = marked.filter("hit").select(*cols).unionByName(new.select(*cols))
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start_ms") - reach > gap_ms).cast("int"), F.lit(1))
    island = F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0))
    united = loose.withColumn("fresh", fresh).withColumn("island", island).groupBy("trace_id", "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_events").alias("n_events"))
    return marked.filter("hit IS NULL").select(*cols).unionByName(united.select(*cols))


class SegmentStore:
    """Active segments kept current by merging: what a stream closed and what came late are both added as intervals, in any order."""

    def __init__(self, spark: SparkSession, root: str, gap_ms: int = IDLE_GAP_MS, buckets: int = BUCKETS):
        self.store = PartitionStore(spark, root, "trace_id string, start_ms bigint, end_ms bigint, n_events bigint")
        self.gap_ms, self.buckets = gap_ms, buckets

    def add(self, run: int, segments: DataFrame) -> bool:
        bucket = bucket_of("trace_id", self.buckets)
        new = segments.select("trace_id", "start_ms", "end_ms", "n_events")
        return self.store.rewrite(run, parts_of(new, bucket), lambda old: merged_segments(old, new, self.gap_ms).withColumn("bucket", bucket))

    def add_events(self, run: int, events: DataFrame) -> bool:
        """Late rows (trace_id, ts_ms)."""
        return self.add(run, active_segments(events, self.gap_ms))

    def read(self) -> DataFrame:
        return self.store.read().drop("bucket")


class BinStore:
    """Activity bins kept current: a row per (bin, agent, session) with its events, in partitions of a day. A run rewrites the days it
    touches; the numbers of sessions and events are folded from the rows when read, so late rows count a session once."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = PartitionStore(spark, root, "start_ms bigint, agent string, trace_id string, n bigint", "day")

    def add(self, run: int, members: DataFrame) -> bool:
        day = F.floor(F.col("start_ms") / (24 * HOUR_MS)).cast("int")
        new = members.select("start_ms", "agent", "trace_id", "n")
        both = lambda old: old.drop("day").unionByName(new).groupBy("start_ms", "agent", "trace_id").agg(F.sum("n").alias("n")).withColumn("day", day)
        return self.store.rewrite(run, parts_of(new, day), both)

    def add_events(self, run: int, events: DataFrame, bin_minutes: int = 5, start_hour: int = 7) -> bool:
        """Late rows (trace_id, agent, ts_ms)."""
        size, start = bin_minutes * 60_000, start_hour * 60 % bin_minutes * 60_000
        at = F.floor((F.col("ts_ms") - start) / size) * size + start
        return self.add(run, events.filter("ts_ms > 0").groupBy(at.alias("start_ms"), "agent", "trace_id").agg(F.count(F.lit(1)).alias("n")))

    def read(self) -> DataFrame:
        return self.store.read().groupBy("start_ms", "agent").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))
