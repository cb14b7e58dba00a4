"""Live session summaries and their change feed from kept state (SS03, SS05, SS10).

A batch reads its own rows only. They are folded per task and session first, so that a session with very many new events reaches
its state as a few rows; the state of a session holds the folded measures, the tool ids seen and the newest events. What the
step of a session gives are its deltas, each with the summary as it then is. History is never read again.

A file's content has a generation, which rises when the file is rewritten. Rows of a higher generation replace what was known, a row
marked ``gone`` removes the session, and rows of an older generation than the known one come too late and count for nothing. A removed
session leaves no state behind.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import sets as T
from .deltas import VERSIONS_PER_BATCH

EVENT = ("trace_id string, generation bigint, gone boolean, index bigint, event_id string, ts_ms bigint, event_kind string, has_error boolean, "
         "tool_use_id string, is_wait boolean")
MEASURES = ("event_count", "error_count", "tool_use_count", "tool_result_count")
_BOUNDS = "first_index bigint, first_ts_ms bigint, last_index bigint, last_ts_ms bigint, telling_index bigint, telling_waits boolean"
_PARTIAL = ("trace_id string, generation bigint, gone boolean, " + ", ".join(f"{m} bigint" for m in MEASURES) + f", {_BOUNDS}, "
            "used array<string>, answered array<string>, newest_index array<bigint>, newest array<string>")
_STATE = ("generation bigint, " + ", ".join(f"{m} bigint" for m in MEASURES) + f", {_BOUNDS}, unmatched bigint, "
          "newest_index array<bigint>, newest array<string>, tool_ids array<string>, tool_bits array<int>, in_map boolean")
_NAMES = tuple(f.split()[0] for f in _STATE.split(", "))
INLINE = 1_000   # tool ids kept in a session's value
DELTA = ("trace_id string, step bigint, type string, appended bigint, latest array<string>, " + ", ".join(f"{m} bigint" for m in MEASURES)
         + ", first_ts_ms bigint, last_ts_ms bigint, unmatched_tool_uses bigint, pending_wait boolean")
_DELTA_ROW = Row(*[f.split()[0] for f in DELTA.split(", ")])
FOLD, FOLD_BYTES = 200_000, 64 << 20   # rows and bytes that a task folds at a time
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_rows(events: DataFrame, generation: int = 0) -> DataFrame:
    """Rows of the live stream from normalised events (``is_wait`` where they have it), all of one generation."""
    wait = F.coalesce("is_wait", F.lit(False)) if "is_wait" in events.columns else F.lit(False)
    own = F.col("generation") if "generation" in events.columns else F.lit(generation).cast("bigint")
    return events.select("trace_id", own.alias("generation"), F.lit(False).alias("gone"), F.col("index").cast("bigint").alias("index"), "event_id", "ts_ms", "event_kind",
                         F.coalesce("has_error", F.lit(False)).alias("has_error"), F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"), wait.alias("is_wait"))


def removal_rows(files: DataFrame) -> DataFrame:
    """Rows that remove the sessions of vanished files (trace_id, generation: the one after the last that was read)."""
    none = lambda t: F.lit(None).cast(t)
    return files.select("trace_id", "generation", F.lit(True).alias("gone"), none("bigint").alias("index"), none("string").alias("event_id"), none("bigint").alias("ts_ms"),
                        none("string").alias("event_kind"), F.lit(False).alias("has_error"), F.lit("").alias("tool_use_id"), F.lit(False).alias("is_wait"))


def folded(events: DataFrame) -> DataFrame:
    """The rows of a task folded to one per session and generation, ``FOLD`` rows at a time, before anything is shuffled."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for b in batches:
            held, rows, size = [*held, b], rows + b.num_rows, size + b.nbytes
            if rows >= FOLD or size >= FOLD_BYTES:
                yield _folded(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
        if rows:
            yield _folded(pa.Table.from_batches(held))
    return events.mapInArrow(fold, _PARTIAL)


def _folded(t: pa.Table) -> pa.RecordBatch:
    """One row per session and generation of ``EVENT`` rows; rows without a session count for nothing."""
    t = t.filter(pc.and_(t["trace_id"].is_valid(), t["generation"].is_valid())).combine_chunks()
    column = lambda c: t[c].combine_chunks()
    true = lambda x: x.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    trace, generation, gone = column("trace_id").dictionary_encode(), column("generation").to_numpy(), true(column("gone"))
    generations, g = np.unique(generation, return_inverse=True)
    group = (trace.indices.to_numpy().astype(np.int64) * max(1, len(generations)) + g) * 2 + gone
    _, head, group = np.unique(group, return_index=True, return_inverse=True)
    n, has_index = len(head), column("index").is_valid().to_numpy(zero_copy_only=False)
    index = column("index").fill_null(2**63 - 1).to_numpy()
    order = np.lexsort((index, group))   # stable; rows without an index come last
    group, index, has_index = group[order], index[order], has_index[order]
    of = lambda x: x[order]
    kind = column("event_kind")
    is_kind = lambda k: of(true(pc.equal(kind, k)))
    uses, answers = is_kind("tool_use"), is_kind("tool_result")
    resolves, ts, timed = uses | answers | is_kind("user"), of(column("ts_ms").fill_null(0).to_numpy()), of(column("ts_ms").is_valid().to_numpy(zero_copy_only=False))
    telling = resolves | of(true(column("is_wait")))
    count = lambda x: pa.array(np.bincount(group[x], minlength=n).astype(np.int64))

    def end(rows: np.ndarray, values: np.ndarray, last: bool) -> pa.Array:
        """The value of each group's first or last row of these."""
        at = np.flatnonzero(rows)
        change = group[at][1:] != group[at][:-1]
        at = at[np.concatenate([change, [True]] if last else [[True], change])] if len(at) else at
        out, none = np.zeros(n, values.dtype), np.ones(n, bool)
        out[group[at]], none[group[at]] = values[at], False
        return pa.array(out, mask=none)

    def lists(of_group: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(of_group, minlength=n))]).astype(np.int32), values)
    tool = pc.fill_null(column("tool_use_id"), "").dictionary_encode()
    names = tool.dictionary
    by_name = pc.array_sort_indices(names).to_numpy()
    place = np.empty(len(names), np.int64)
    place[by_name] = np.arange(len(names))
    named, tool = of(true(pc.not_equal(pc.fill_null(column("tool_use_id"), ""), ""))), place[of(tool.indices.to_numpy())]

    def tools(rows: np.ndarray) -> pa.Array:
        """The distinct tool ids of these rows, in order."""
        some = np.unique(group[rows] * max(1, len(names)) + tool[rows])
        return lists(some // max(1, len(names)), names.take(pa.array(by_name[some % max(1, len(names))])))
    ids = column("event_id")
    at = np.flatnonzero(of(ids.is_valid().to_numpy(zero_copy_only=False)))
    left = np.cumsum(np.bincount(group[at], minlength=n))[group[at]] - np.arange(len(at))   # rows of the group from this one on
    at = at[left <= T.LATEST_EVENTS]
    first = pa.array(head)
    return pa.RecordBatch.from_arrays([
        column("trace_id").take(first), column("generation").take(first), pa.array(gone[head]),
        count(~of(gone)), count(of(true(column("has_error")))), count(uses), count(answers),
        end(timed & has_index, index, False), end(timed, ts, False), end(timed & has_index, index, True), end(timed, ts, True),
        end(telling & has_index, index, True), end(telling, ~resolves, True),
        tools(uses & named), tools(answers & named), lists(group[at], pa.array(index[at], mask=~has_index[at])), lists(group[at], ids.take(pa.array(order[at])))],
        [f.split()[0] for f in _PARTIAL.split(", ")])


class LiveSession(StatefulProcessor):
    """One session's kept summary: one value with the folded measures, the newest events and the tool ids seen (1 used, 2 answered, 3
    both). A session with more than ``INLINE`` ids has them in a map, so that its value stays small; each call to the state costs. A step
    has a few folded rows and works on them as they are: a data frame for each would take most of the time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", _STATE)
        self.tools = handle.getMapState("tools", "tool_use_id string", "seen int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        parts: dict[int, list[Row]] = {}
        for r in rows:
            parts.setdefault(r["generation"], []).append(r.asDict())
        kept = self.session.get()
        known, out = dict(zip(_NAMES, kept)) if kept is not None else None, []
        for generation, some in sorted(parts.items()):
            if known is not None and generation < known["generation"]:
                continue
            if any(r["gone"] for r in some):
                if known is not None:
                    out.append(self._delta(key, len(out), "trace_removed", known))
                    self._forget(known)
                    known = None
                continue
            added, before = known is None, known["event_count"] if known is not None else 0
            if added or generation > known["generation"]:   # the first content, or one that replaces what was known
                if not added:
                    self._forget(known)
                known = dict.fromkeys(_NAMES) | dict.fromkeys((*MEASURES, "unmatched"), 0) | {"generation": generation, "in_map": False} | \
                    {c: [] for c in ("newest_index", "newest", "tool_ids", "tool_bits")}
            self._merge(known, some)
            appended = known["event_count"] - before
            out.append(self._delta(key, len(out), "trace_added" if added else "trace_updated", known))
            if appended > 0:
                out.append(self._delta(key, len(out), "events_appended", known, appended, known["newest"][-min(T.LATEST_EVENTS, appended):]))
        if known is not None:
            self.session.update(tuple(known[c] for c in _NAMES))
        elif kept is not None:
            self.session.clear()
        yield from out

    def _forget(self, known: dict) -> None:
        if known["in_map"]:
            self.tools.clear()

    def _merge(self, known: dict, some: list[dict]) -> None:
        recent, seen = dict(zip(known["newest_index"], known["newest"])), {}
        for r in some:
            for m in MEASURES:
                known[m] += r[m]
            for at, value, better in (("first_index", "first_ts_ms", lambda x, y: x < y), ("last_index", "last_ts_ms", lambda x, y: x > y),
                                      ("telling_index", "telling_waits", lambda x, y: x > y)):
                if r[at] is not None and (known[at] is None or better(r[at], known[at])):
                    known[at], known[value] = r[at], r[value]
            recent.update(zip(r["newest_index"], r["newest"]))
            for bit, ids in ((1, r["used"]), (2, r["answered"])):
                for t in ids:
                    seen[t] = seen.get(t, 0) | bit
        known["newest_index"] = sorted(recent)[-T.LATEST_EVENTS:]
        known["newest"] = [recent[i] for i in known["newest_index"]]
        inline = dict(zip(known["tool_ids"], known["tool_bits"]))
        for t, bits in seen.items():
            if known["in_map"]:
                old = self.tools.getValue((t,))[0] if self.tools.containsKey((t,)) else 0
            else:
                old = inline.get(t, 0)
            if old | bits != old:
                if known["in_map"]:
                    self.tools.updateValue((t,), (old | bits,))
                else:
                    inline[t] = old | bits
                known["unmatched"] += (old | bits == 1) - (old == 1)
        if len(inline) > INLINE:
            for t, bits in inline.items():
                self.tools.updateValue((t,), (bits,))
            inline, known["in_map"] = {}, True
        known["tool_ids"], known["tool_bits"] = list(inline), list(inline.values())

    @staticmethod
    def _delta(key, step: int, kind: str, known: dict, appended: int | None = None, latest: list | None = None) -> Row:
        return _DELTA_ROW(key[0], step, kind, appended, latest or [], *[known[m] for m in MEASURES], known["first_ts_ms"], known["last_ts_ms"], known["unmatched"],
                          bool(known["telling_waits"]))

    def close(self) -> None:
        pass


def live_deltas(events: DataFrame) -> DataFrame:
    """Deltas of a stream of ``EVENT`` rows: trace_added, trace_updated or trace_removed, then events_appended with the number and the
    newest events (at most 40) of what came. ``step`` orders a session's deltas inside a batch."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)   # the only store with list and map state
    return folded(events).groupBy("trace_id").transformWithState(LiveSession(), DELTA, "Update", "None")


class LiveSink:
    """``foreachBatch`` sink of ``live_deltas``: numbers the deltas with rising versions and appends ``overview_updated`` where a session
    changed. A batch owns its folder, so a repeated one writes the same again; followers read folder by folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("trace_id"), F.lit(4096))
        place = F.row_number().over(W.partitionBy(bucket).orderBy("trace_id", "step"))
        numbered = batch.withColumn("version", F.lit(batch_id * VERSIONS_PER_BATCH) + place * 4096 + bucket).drop("step")
        numbered.write.mode("overwrite").parquet(f"{self.root}/sessions/batch={batch_id}")
        done = self.spark.read.schema(numbered.schema).parquet(f"{self.root}/sessions/batch={batch_id}")
        overview = done.filter(F.col("type").startswith("trace_")).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
            *[F.lit({"trace_id": "", "type": "overview_updated", "version": (batch_id + 1) * VERSIONS_PER_BATCH - 1}.get(f.name)).cast(f.dataType).alias(f.name)
              for f in done.schema])
        done.unionByName(overview).write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch_id}")

    def deltas(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/deltas").parquet(f"{self.root}/deltas")


def drain_live(stream: DataFrame, root: str) -> LiveSink:
    """Runs the feed over all that has come since the last call; state, checkpoint and deltas lie below ``root``."""
    sink = LiveSink(stream.sparkSession, f"{root}/feed")
    (live_deltas(stream).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{root}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return sink


# ---- from two listings to the stream (SS03) ------------------------------------------------------------------------

LEDGER = "trace_id string, path string, size_bytes bigint, mtime_ms bigint, generation bigint, last_index bigint, gone boolean"


class LiveFiles:
    """Compares a listing with the ledger of the run before, parses new, grown and rewritten files again and hands their events to the stream.

    ``parse(paths) -> events`` normalises the named files. A grown file gives the events after the last known one; a rewritten one
    all of them in the next generation; a vanished one a removal. Each run owns a folder of the ledger and one of the stream.
    Paths of changed files reach the driver in parts of ``PATHS`` at most.
    """

    PATHS = 10_000

    def __init__(self, spark: SparkSession, root: str, parse: Callable[[list[str]], DataFrame]):
        self.spark, self.root, self.parse = spark, root.rstrip("/"), parse

    def _ledger(self, run: int) -> DataFrame:
        if run == 0:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/run={run - 1}")

    def refresh(self, listing: DataFrame, run: int) -> DataFrame:
        """One run, numbered from 0, over a listing (trace_id, path, size_bytes, mtime_ms); gives (trace_id, action)."""
        old = self._ledger(run)
        known, now = old.filter("NOT gone"), listing.select("trace_id", "path", "size_bytes", "mtime_ms")
        before = old.select("trace_id", *[F.col(c).alias(f"old_{c}") for c in ("path", "size_bytes", "mtime_ms", "generation", "last_index", "gone")])
        path = f"{self.root}/actions/run={run}"
        acts = T.change_actions(known.select("trace_id", "size_bytes", "mtime_ms"), now).join(now, "trace_id", "left").join(before, "trace_id", "left")
        g = F.coalesce("old_generation", F.lit(-1).cast("bigint"))
        acts = acts.withColumn("generation", F.when(F.col("action").isin("same", "grown"), g).otherwise(g + 1))
        acts.write.mode("overwrite").parquet(path)
        acts = self.spark.read.schema(acts.schema).parquet(path)
        changed = acts.filter(F.col("action").isin("new", "grown", "rewritten"))
        target = f"{self.root}/stream/run={run}"
        removal_rows(acts.filter("action = 'vanished'")).write.mode("overwrite").parquet(f"{target}/gone")
        todo, part = changed.select("path").toLocalIterator(), 0
        while names := [r.path for _, r in zip(range(self.PATHS), todo)]:
            after = changed.select("trace_id", "generation", F.when(F.col("action") == "grown", F.col("old_last_index")).otherwise(0).alias("__after"))
            fresh = self.parse(names).join(after, "trace_id").filter(F.col("index") > F.col("__after")).drop("__after")
            event_rows(fresh).write.mode("overwrite").parquet(f"{target}/part{part}")
            part += 1
        read = self.spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(target).filter("NOT gone")
        last = read.groupBy("trace_id").agg(F.max("index").alias("__last"))
        # files that vanished stay in the ledger with their generation, so that one which comes back begins a new one
        gone = F.col("action") == "vanished"
        left = F.when(F.col("action").isin("grown", "same"), F.coalesce("__last", "old_last_index")).otherwise(F.coalesce("__last", F.lit(0)))
        ledger = acts.join(last, "trace_id", "left").select(
            "trace_id", F.coalesce("path", "old_path").alias("path"), F.coalesce("size_bytes", "old_size_bytes").alias("size_bytes"),
            F.coalesce("mtime_ms", "old_mtime_ms").alias("mtime_ms"), "generation", left.cast("bigint").alias("last_index"), gone.alias("gone"))
        rest = old.filter("gone").join(acts.select("trace_id"), "trace_id", "left_anti")
        ledger.unionByName(rest).write.mode("overwrite").parquet(f"{self.root}/ledger/run={run}")
        return acts.select("trace_id", "action")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{self.root}/stream")
