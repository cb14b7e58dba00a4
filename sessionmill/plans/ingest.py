"""From log files to session tables: the whole batch job (SC13 for one file, SC11 routing, AG01)."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import times
from ..functions.ids import stable_id
from ..operators import usage_rows as U
from ..operators.ordered import staged
from ..operators.pricing import rate_table, window_table
from ..operators.sessions import summarize
from ..params import CostParams, StatusParams
from ..schemas import EVENT_COLUMNS, EVENT_SCHEMA
from ..sources import scan, trees
from ..sources.formats import opencode
from ..sources.formats.registry import HEAD_CHARS, FormatRegistry


@dataclass
class Logs:
    """Tables of one ingest: files with their format, unredacted events, priced usage rows, session summaries."""
    files: DataFrame
    events: DataFrame
    usage: DataFrame | None
    sessions: DataFrame


DOCUMENT_COLUMNS = ("trace_id", "path", "size_bytes", "mtime_ms", "doc_session_id", "row_no", "offset", "raw_json", "v")


def heads(lines: DataFrame) -> DataFrame:
    """First ``HEAD_CHARS`` characters of every file, put together from its first lines."""
    near = lines.filter(F.col("offset") < HEAD_CHARS).withColumn("line", F.substring("line", 1, HEAD_CHARS))
    parts = near.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("l"))
    return parts.select("trace_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("head"))


def _usage_source(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts_ms", times.guess_ts("v")).select("trace_id", "row_no", "ts_ms", "v")


@dataclass(frozen=True)
class Sources:
    """Which files below the paths are logs, and whose (UX03): session directories and named profiles, ``~`` is ``home``."""
    directories: tuple[scan.LogDirectory, ...] = scan.DEFAULT_DIRECTORIES
    profiles: tuple[scan.Profile, ...] = scan.DEFAULT_PROFILES
    home: str = "~"


def listed_files(spark: SparkSession, paths: list[str], host: str, sources: Sources | None, found: DataFrame | None = None) -> DataFrame:
    """The files to read with source, agent and parser hints. With ``sources`` those that belong to one (SC10); without, every
    file below the paths but compaction side chains (SC09), attributed where a default source owns its path (SC12)."""
    files = scan.log_files(spark, paths, host, found=found)
    if sources is not None:
        return scan.without_superseded_diffs(scan.discover(files, sources.directories, sources.profiles, sources.home))
    src = scan.attribution(F.col("path"))
    return files.filter(~scan.is_compaction_side_chain(F.col("path"))).withColumns({
        "source_profile": F.coalesce(src["source_profile"], F.lit("")), "agent_hint": src["agent_hint"], "parser_hint": F.lit(None).cast("string")})


def read_logs(spark: SparkSession, paths: list[str], now_ms: int, *, host: str = "", hint: str | None = None, sources: Sources | None = None,
              registry: FormatRegistry | None = None, rates: DataFrame | None = None, windows: DataFrame | None = None,
              side_table: DataFrame | None = None, cost: CostParams = CostParams(), status: StatusParams = StatusParams()) -> Logs:
    """Reads the files below the paths, each in its own format, and derives their sessions.

    Multi-file sessions are read by ``read_entities``. Metrics come from the unredacted rows; redact before showing.
    """
    registry = registry or FormatRegistry()
    rates, windows = (rates if rates is not None else rate_table(spark)), (windows if windows is not None else window_table(spark))
    # the placed lines and the routing are read by every format and again by the metrics: written once
    found = trees.tree(spark, paths)
    lines, files = staged(scan.lines(spark, paths, host, found)), listed_files(spark, paths, host, sources, found)
    wanted = F.coalesce(F.lit(hint).cast("string"), F.col("parser_hint"))
    name = registry.choose(F.col("path"), F.coalesce("head", F.lit("")), wanted)
    files = staged(files.join(heads(lines), "trace_id", "left").withColumn("format", name).drop("head", "parser_hint"))
    chosen = files.select("trace_id", "format", F.lit(hint).cast("string").alias("agent_hint"))
    # at most one row per registered format
    present = {r.format for r in files.select("format").distinct().collect()}
    of = lambda f: chosen.filter(F.col("format") == f).select("trace_id")
    own = lambda f: lines.filter(~F.col("path").rlike(r"(?i)\.json$")).join(of(f), "trace_id", "left_semi")

    parts, usages, sessions = [], [], []

    def add_usage(rows: DataFrame, **kw) -> None:
        done = U.priced(rows, rates, windows, cost)
        usages.append(done)
        by_rows = kw.pop("by_rows", True)
        price = U.session_cost(done, cost) if by_rows else U.session_cost_on_model_totals(done, rates, cost)
        sessions.append(U.session_usage(done, cost=price, **kw))

    for f in registry.formats:
        if f.name not in present or f.normalize is None:
            continue
        rows = scan.json_rows(own(f.name))
        if f.name == "gemini":
            # a file of either extension may be one document; what is none is read line by line
            own_files = found.withColumn("trace_id", stable_id(F.col("path"), F.lit(host))).join(of(f.name).withColumn("own", F.lit(True)), "trace_id", "left")
            own_files = own_files.filter(F.col("folder") | F.col("error").isNotNull() | (F.col("own") & (F.col("size_bytes") <= scan.DOCUMENT_BYTES))).drop("own", "trace_id")
            docs = scan.documents(spark, paths, host, "*.json*", own_files).filter(F.col("size_bytes") <= scan.DOCUMENT_BYTES)
            docs = docs.filter(scan.is_document(F.col("text")))
            apart = trees.read_documents(scan.apart_documents(found, host, "*.json*").join(of(f.name), "trace_id", "left_semi"))
            whole = staged(docs.select("trace_id").unionByName(apart.select("trace_id").distinct()))
            rest = lines.join(of(f.name), "trace_id", "left_semi").join(whole, "trace_id", "left_anti")
            rows = scan.document_rows(docs).unionByName(apart).unionByName(scan.json_rows(rest).withColumn("doc_session_id", F.lit("")).select(*DOCUMENT_COLUMNS))
        ev = f.normalize(own(f.name), side_table) if f.name == "cursor" else f.normalize(own(f.name) if f.reads == "lines" else rows)
        agent = F.coalesce(F.lit(hint), F.lit("unknown")) if f.name == "generic" else F.lit(f.agent)
        parts.append(ev.select(*EVENT_COLUMNS, F.lit(f.name).alias("format"), agent.alias("agent")))
        src = _usage_source(rows)
        if f.name == "claude":
            add_usage(U.claude_usage(src))
        elif f.name == "codex":
            add_usage(U.codex_usage(src), totals=U.codex_totals(src), estimated_shares=True)
        elif f.name == "pi":
            add_usage(U.pi_usage(src))
        elif f.name == "gemini":
            add_usage(U.gemini_usage(src), by_rows=False)
        elif f.name == "cursor":
            add_usage(U.estimated_usage(ev), by_rows=False, estimated_shares=True)
    union = lambda dfs: reduce(DataFrame.unionByName, dfs) if dfs else None
    events = union(parts)
    if events is None:
        events = spark.createDataFrame([], EVENT_SCHEMA).withColumns({"format": F.lit(""), "agent": F.lit("")})
    return _finish(files, staged(events), union(usages), union(sessions), now_ms, status)


def _finish(files: DataFrame, events: DataFrame, usage: DataFrame | None, session_use: DataFrame | None, now_ms: int, status: StatusParams) -> Logs:
    heads_ = events.groupBy("trace_id").agg(F.max_by("session_id", "index").alias("session_id"), F.first("agent").alias("agent"))
    listed = scan.ingest_errors(files.drop("session_id", "agent"), events).join(heads_, "trace_id", "left").fillna("", ["session_id"])
    listed = listed.withColumn("agent", F.coalesce("agent", F.lit("unknown"))).withColumn("parser", F.col("format"))
    sessions = summarize(events.drop("format", "agent"), listed, now_ms, session_use, status)
    return Logs(files, events, usage, sessions)


def read_entities(spark: SparkSession, root: str, now_ms: int, *, host: str = "", diffs: bool = False, exported: DataFrame | None = None,
                  exported_messages: DataFrame | None = None, exported_parts: DataFrame | None = None, rates: DataFrame | None = None,
                  windows: DataFrame | None = None, cost: CostParams = CostParams(), status: StatusParams = StatusParams()) -> Logs:
    """The same for multi-file sessions (session, message and part files below ``root``/storage)."""
    rates, windows = (rates if rates is not None else rate_table(spark)), (windows if windows is not None else window_table(spark))
    s = scan.entities(spark, root, "session").withColumn("trace_id", stable_id(F.col("path"), F.lit(host)))
    if diffs:
        # a diff file stands for its session only where that has no file of its own (JN06)
        d = scan.entities(spark, root, "session_diff").withColumn("trace_id", stable_id(F.col("path"), F.lit(host)))
        s = scan.without_superseded_diffs(s.unionByName(d))
    if exported is not None:
        s = opencode.overlay_sessions(opencode.session_fields(s), exported)
    events = opencode.normalize(s, scan.entities(spark, root, "message"), scan.entities(spark, root, "part"), exported_messages, exported_parts)
    events = events.withColumns({"format": F.lit("opencode"), "agent": F.lit("opencode")})
    rows = events.select("trace_id", F.col("index").alias("row_no"), "ts_ms", F.try_parse_json("raw_json").alias("v"))
    priced = U.priced(U.opencode_usage(rows), rates, windows, cost)
    source = F.coalesce(scan.attribution(F.col("path"))["source_profile"], F.lit(""))
    files = s.select("trace_id", "path", "size_bytes", "mtime_ms", source.alias("source_profile"), F.lit("opencode").alias("format"))
    return _finish(files, events, priced, U.session_usage(priced, cost=U.session_cost(priced, cost)), now_ms, status)
