"""Growing log files as a stream of immutable chunks (SS01, SS02).

A log shipper rolls each growing file into chunk files ``<source path>.<number>.chunk``, numbered from 0. One state row
per file keeps the text after the last line break, the place reached, and chunks that came too early.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.ids import stable_id
from ..sources.scan import json_rows

LINES = "trace_id string, path string, mtime_ms bigint, size_bytes bigint, row_no bigint, offset bigint, line string"
STATE = ("pending string, rows bigint, seen_bytes bigint, seen_chars bigint, next_chunk bigint, early_no array<bigint>, early_text array<string>,"
         " early_mtime array<bigint>")


def chunk_stream(spark: SparkSession, directory: str, host: str = "", max_files: int = 1000) -> DataFrame:
    """(trace_id, path, chunk_no, text, mtime_ms) of newly arrived chunk files."""
    raw = (spark.readStream.format("text").schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", max_files)
           .option("pathGlobFilter", "*.chunk").option("recursiveFileLookup", "true").load(directory))
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:(?://)?(?=/)", "")
    path = F.regexp_extract(name, r"^(.*)\.(\d+)\.chunk$", 1)
    return raw.select(stable_id(path, F.lit(host)).alias("trace_id"), path.alias("path"),
                      F.regexp_extract(name, r"\.(\d+)\.chunk$", 1).cast("bigint").alias("chunk_no"), F.col("value").alias("text"),
                      F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"))


def split_complete(text: str) -> tuple[str, str]:
    """(complete lines, rest): the text after the last line break waits, unless it is alone and a whole JSON object."""
    cut = max(text.rfind("\n"), text.rfind("\r")) + 1
    if cut:
        return text[:cut], text[cut:]
    try:
        whole = isinstance(json.loads(text), dict) if text.strip() else False
    except ValueError:
        whole = False
    return (text, "") if whole else ("", text)


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending, rows, seen, chars, nxt, e_no, e_text, e_time = state.get if state.exists else ("", 0, 0, 0, 0, [], [], [])
    waiting = {int(n): (t, int(m)) for n, t, m in zip(e_no, e_text, e_time)}
    path = ""
    for pdf in batches:
        for p, n, t, m in zip(pdf["path"], pdf["chunk_no"], pdf["text"], pdf["mtime_ms"]):
            path = p
            if n >= nxt:
                waiting[int(n)] = (t, int(m))
    out = []
    while nxt in waiting:
        chunk, mtime = waiting.pop(nxt)
        nxt += 1
        # offsets count characters as the batch reader's do, so that one line has one event id in both
        base = chars - len(pending)
        seen += len(chunk.encode("utf-8"))
        chars += len(chunk)
        complete, pending = split_complete(pending + chunk)
        at = base
        pieces = complete.replace("\r\n", "\n").split("\n")
        for line in pieces[:-1] if complete.endswith("\n") else pieces:
            rows += 1
            if line.strip():
                out.append((key[0], path, mtime, seen, rows, at, line))
            at += len(line) + 1
    early = sorted(waiting)
    state.update((pending, rows, seen, chars, nxt, early, [waiting[n][0] for n in early], [waiting[n][1] for n in early]))
    yield pd.DataFrame(out, columns=["trace_id", "path", "mtime_ms", "size_bytes", "row_no", "offset", "line"])


def complete_lines(chunks: DataFrame) -> DataFrame:
    """Whole lines of the growing files with their row number and offset running on over the chunks."""
    return chunks.groupBy("trace_id").applyInPandasWithState(_advance, LINES, STATE, "append", GroupStateTimeout.NoTimeout)


class EventSink:
    """``foreachBatch`` sink: normalises new lines and appends their events, numbers running on per session.

    Each batch owns one partition of the event table and of the table of heads (last number and session id per trace),
    so a repeated batch overwrites its own output and nothing else.
    """

    def __init__(self, spark: SparkSession, root: str, normalize):
        self.spark, self.root, self.normalize = spark, root.rstrip("/"), normalize
        self.heads_schema = "trace_id string, last_index bigint, session_id string, batch bigint"

    def heads(self, before_batch: int) -> DataFrame:
        """Newest head per trace of the batches before this one."""
        path = f"{self.root}/heads"
        jvm = self.spark._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        if not hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hpath):
            return self.spark.createDataFrame([], self.heads_schema)
        log = self.spark.read.schema(self.heads_schema).option("basePath", path).parquet(path).filter(F.col("batch") < before_batch)
        rest = F.struct("last_index", "session_id", "batch")
        return log.groupBy("trace_id").agg(F.max_by(rest, "batch").alias("h")).select("trace_id", "h.*")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        ev = self.normalize(json_rows(batch))
        h = self.heads(batch_id).select("trace_id", F.col("last_index").alias("__last"), F.col("session_id").alias("__sid"))
        merged = ev.join(h, "trace_id", "left").fillna(0, ["__last"]).fillna("", ["__sid"])
        sid = F.when(F.col("session_id") != "", F.col("session_id")).otherwise(F.col("__sid"))
        based = merged.withColumns({"index": F.col("index") + F.col("__last"), "session_id": sid})
        based = based.withColumn("event_id", F.concat_ws(":", "trace_id", "index", "offset")).drop("__last", "__sid")
        based.select(*[c for c in ev.columns]).write.mode("overwrite").parquet(f"{self.root}/events/batch={batch_id}")
        done = self.spark.read.parquet(f"{self.root}/events/batch={batch_id}")
        heads = done.groupBy("trace_id").agg(F.max("index").alias("last_index"), F.max_by("session_id", "index").alias("session_id"))
        heads.write.mode("overwrite").parquet(f"{self.root}/heads/batch={batch_id}")

    def events(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/events").parquet(f"{self.root}/events")
