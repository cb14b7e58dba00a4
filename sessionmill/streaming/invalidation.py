"""Changed files of multi-file sessions derive their sessions again, and no others (SS04).

Three stores are kept in hash buckets: ``links`` (message id to session), ``entities`` (every session, message and part file with the session it
belongs to; parts whose message is not known yet wait in a bucket of their own) and ``events``. A run compares the listing with the
stored files, reads the changed ones, looks up which sessions they and the vanished ones belong to, and rewrites the buckets of
those sessions: in ``events`` only the rows of these sessions are derived again.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..functions import variants as V
from ..functions.ids import stable_id
from ..operators.ordered import scratch_dir
from ..schemas import EVENT_COLUMNS, EVENT_SCHEMA
from ..sources import scan, trees
from ..sources.formats import opencode
from .stores import BUCKETS, PartitionStore, bucket_of, folder_names, parts_of

KINDS = ("session", "session_diff", "message", "part")
WAITING = -1   # the bucket of parts without a known message
_ENTITY = "kind string, session_id string, key string, owner string, mid string, path string, size_bytes bigint, mtime_ms bigint, raw_json string"
_COLUMNS = [c.split()[0] for c in _ENTITY.split(", ")]
PATHS = 10_000  # packed paths named to the reader at a time


def kind_of(path: Column) -> Column:
    """Which kind of entity a file is, by its folder below ``storage``; null for others."""
    return F.nullif(F.regexp_extract(path, r"/storage/(session|session_diff|message|part)/", 1), F.lit(""))


class SessionFiles:
    """The kept tables of one tree of session, message and part files."""

    def __init__(self, spark: SparkSession, root: str, host: str = "", buckets: int = BUCKETS):
        self.spark, self.root, self.host, self.buckets = spark, root.rstrip("/"), host, buckets
        self.entities = PartitionStore(spark, f"{self.root}/entities", _ENTITY)
        self.links = PartitionStore(spark, f"{self.root}/links", "mid string, session_id string")
        events = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA)
        self.events = PartitionStore(spark, f"{self.root}/events", f"{events}, of_session string")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], _ENTITY)

    def _of_session(self) -> Column:
        return F.when(F.col("session_id") == "", F.lit(WAITING)).otherwise(bucket_of("session_id", self.buckets))

    def _read(self, paths: DataFrame) -> DataFrame:
        """The named files that hold a JSON object, with their own ids, opened by tasks. Names of packed ones pass the driver in parts of ``PATHS``."""
        out, seen = f"{scratch_dir(self.spark)}/read", paths.select("path").filter(~trees.hidden())
        found, packed = self._empty().drop("session_id"), seen.filter(trees.packed()).toLocalIterator()

        def keep(docs: DataFrame) -> None:
            v, path = F.try_parse_json("raw_json"), F.col("path")
            rows = docs.withColumn("v", v).filter(V.is_object(F.col("v"))).select(
                kind_of(path).alias("kind"), X.basename_stem(path).alias("key"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("owner"),
                X.strip(V.text(F.col("v"), "$.id")).alias("mid"), "path", "size_bytes", "mtime_ms", "raw_json")
            rows.write.mode("append").parquet(out)
        keep(trees.read_texts(seen.filter(~trees.packed())).withColumnRenamed("text", "raw_json"))
        while names := [r.path for _, r in zip(range(PATHS), packed)]:
            keep(self.spark.read.format("text").option("wholetext", "true").option("ignoreMissingFiles", "true").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", n) for n in names]).select(
                *scan._file_columns(), F.col("value").alias("raw_json")))
        return self.spark.read.schema(found.schema).parquet(out)

    def _normalized(self, entities: DataFrame) -> DataFrame:
        """Events of whole sessions from their entity rows."""
        e = entities.withColumn("v", F.try_parse_json("raw_json"))
        of = lambda kind: e.filter(F.col("kind") == kind).select("key", "owner", "path", "size_bytes", "mtime_ms", "raw_json", "v")
        sessions = scan.without_superseded_diffs(of("session").unionByName(of("session_diff"))).withColumn("trace_id", stable_id(F.col("path"), F.lit(self.host)))
        fields = opencode.session_fields(sessions)
        events = opencode.normalize(fields, of("message"), of("part")).select(*EVENT_COLUMNS)
        return events.join(fields.select("trace_id", F.col("session_id").alias("of_session")), "trace_id")

    def _plan(self, listing: DataFrame, work: str) -> None:
        """What a run has to do, written down before anything is changed: changed paths, rows read, links, adopted parts, affected sessions."""
        spark, kept = self.spark, lambda df, name: df.write.mode("overwrite").parquet(f"{work}/{name}")
        files = listing.select("path", "size_bytes", "mtime_ms").filter(kind_of(F.col("path")).isNotNull())
        stored = self.entities.read().select("path", F.col("size_bytes").alias("old_size"), F.col("mtime_ms").alias("old_mtime"), F.col("session_id").alias("old_session"))
        both = files.join(stored, "path", "full")
        same = F.coalesce((F.col("size_bytes") == F.col("old_size")) & (F.col("mtime_ms") == F.col("old_mtime")), F.lit(False))
        kept(both.filter(~same).select("path", F.col("size_bytes").isNull().alias("gone"), "old_session"), "changed")
        changed = spark.read.schema("path string, gone boolean, old_session string").parquet(f"{work}/changed")
        read = self._read(changed.filter("NOT gone"))
        # the dependency index: messages name their session by their folder, parts their message
        kept(read.filter("kind = 'message' AND mid <> ''").groupBy("mid").agg(F.min("owner").alias("session_id")), "links")
        links = spark.read.schema("mid string, session_id string").parquet(f"{work}/links")
        owners = parts_of(read.filter("kind = 'part'"), bucket_of("owner", self.buckets))
        known = self.links.read(owners).select("mid", F.col("session_id").alias("old_link")).join(links.withColumnRenamed("session_id", "new_link"), "mid", "full").select(
            F.col("mid").alias("__m"), F.coalesce("new_link", "old_link").alias("linked"))
        named = read.join(known, (F.col("kind") == "part") & (F.col("owner") == F.col("__m")), "left")
        own = F.when(F.col("kind") == "session", V.first_filled(F.col("mid"), F.col("key"))).when(F.col("kind") == "session_diff", F.col("key")).when(
            F.col("kind") == "message", F.col("owner")).otherwise(F.coalesce("linked", F.lit("")))
        kept(named.withColumn("session_id", own).select(*_COLUMNS), "fresh")
        fresh = spark.read.schema(_ENTITY).parquet(f"{work}/fresh")
        # parts that waited for a message that has come now
        waiting = self.entities.read([WAITING]).join(changed.select("path"), "path", "left_anti").drop("session_id", "bucket")
        kept(waiting.join(links.withColumnRenamed("mid", "owner"), "owner").select(*_COLUMNS), "adopted")
        ids = fresh.select("session_id").union(spark.read.schema(_ENTITY).parquet(f"{work}/adopted").select("session_id")).union(changed.select("old_session"))
        kept(ids.filter("session_id <> ''").distinct(), "affected")

    def refresh(self, listing: DataFrame, run: int) -> DataFrame:
        """One run, numbered from 0, over a listing (path, size_bytes, mtime_ms) of the tree; gives the ids of the sessions derived again.
        A run that failed goes on from its plan when it is called again."""
        work, read = f"{self.root}/work/run={run}", self.spark.read
        if "_SUCCESS" not in folder_names(self.spark, f"{work}/affected"):
            self._plan(listing, work)
        changed, links = read.schema("path string, gone boolean, old_session string").parquet(f"{work}/changed"), read.schema("mid string, session_id string").parquet(f"{work}/links")
        fresh, adopted = (read.schema(_ENTITY).parquet(f"{work}/{n}") for n in ("fresh", "adopted"))
        affected = read.schema("session_id string").parquet(f"{work}/affected")
        buckets, mids = parts_of(affected, bucket_of("session_id", self.buckets)), bucket_of("mid", self.buckets)
        self.links.rewrite(run, parts_of(links, mids), lambda old: old.drop("bucket").join(links.select("mid"), "mid", "left_anti").unionByName(links).withColumn("bucket", mids))
        moved = changed.select("path").union(adopted.select("path")).distinct()
        self.entities.rewrite(run, [WAITING, *buckets], lambda old: old.drop("bucket").join(moved, "path", "left_anti").unionByName(fresh).unionByName(adopted).withColumn(
            "bucket", self._of_session()))

        def derived(old: DataFrame) -> DataFrame:
            mine = self.entities.read(buckets).join(affected, "session_id", "left_semi").drop("bucket")
            rest = old.drop("bucket").join(affected.withColumnRenamed("session_id", "of_session"), "of_session", "left_anti")
            return rest.unionByName(self._normalized(mine)).withColumn("bucket", bucket_of("of_session", self.buckets))
        self.events.rewrite(run, buckets, derived)
        return affected

    def read(self) -> DataFrame:
        return self.events.read().drop("bucket", "of_session")
