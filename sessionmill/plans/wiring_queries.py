"""Queries on what only whole jobs used before: ad-hoc scans with formats of one's own, custom profiles, placeholders, merged times, stamps, pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as T
from ..operators.ordered import running, scratch_dir
from ..sources import scan
from ..sources.formats import generic, opencode
from ..sources.formats.registry import Format, FormatRegistry
from ..streaming import deltas
from . import datasets as D
from .ingest import read_logs
from .oracle import EVENTS, SESS, q
from .registry import query

_C, _S = F.col, F.struct
_LINES = 500   # rows of a file


def _logs(spark, sf):
    """All events as JSON lines in files of at most ``_LINES`` rows of a session, in hidden folders and with hidden names as well."""
    e = running(D.events(spark, sf).select("trace_id", "index", "ts_ms", "raw_type", "preview"), ["trace_id"], "index", {"n": ("count", None)})
    line = F.to_json(_S(_C("raw_type").alias("type"), _C("preview").alias("text"), _C("ts_ms").alias("timestamp")))
    files = e.groupBy("trace_id", F.floor((_C("n") - 1) / _LINES).cast("bigint").alias("part")).agg(F.sort_array(F.collect_list(_S("n", line.alias("line")))).alias("l"))
    name = F.concat(F.when(_C("trace_id").cast("bigint") % 3 == 0, ".logs/").otherwise("logs/"), F.when(_C("trace_id").cast("bigint") % 2 == 0, ".").otherwise(""),
                    "trace_id", F.lit("-"), "part", F.lit(".jsonl"))
    root = scratch_dir(spark)
    scan.write_files(files.select(name.alias("name"), F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text")), root)
    return root


@query(q(f"""SELECT trace_id AS name, (n - 1) // {_LINES} AS part, 'house' AS parser, count(*) AS event_count, max(ts_ms) AS newest_ms, count(*) FILTER (WHERE raw_type = 'error') AS errors
  FROM (SELECT ev.*, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM ev) GROUP BY ALL""", EVENTS))
def adhoc_scan(spark, sf):
    """Files outside all sources, hidden ones among them, read in a format of one's own that the registry is given (SC13, UX01, UX02)."""
    house = Format("house", "unknown", lambda p, h: F.when(h.contains('"type"') & h.contains('"text"'), F.lit("0.9").cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)")),
                   generic.normalize)
    logs = read_logs(spark, [_logs(spark, sf)], D.NOW_MS, registry=FormatRegistry().register(house))
    where = lambda i: F.regexp_extract("path", r"/\.?(\d+)-(\d+)\.jsonl$", i)
    most = logs.events.groupBy("trace_id").agg(F.max("ts_ms").alias("newest_ms"), F.count_if(_C("raw_type") == "error").alias("errors"))
    return logs.sessions.join(most, "trace_id").select(where(1).alias("name"), where(2).cast("bigint").alias("part"), "parser", "event_count", "newest_ms", "errors")


@query(q("""SELECT trace_id, CASE WHEN CAST(trace_id AS BIGINT) % 5 = 4 THEN 'house_deep' ELSE 'house' END AS source_profile,
  CASE WHEN CAST(trace_id AS BIGINT) % 5 = 4 THEN 'pi' ELSE 'unknown' END AS agent_hint FROM sess WHERE CAST(trace_id AS BIGINT) % 5 IN (0, 1, 4)""", EVENTS, SESS))
def custom_profiles(spark, sf):
    """Profiles of one's own: any name, lines by default, wanted and unwanted names, the largest depth (UX03)."""
    i = _C("trace_id").cast("bigint") % 5
    path = F.concat(F.lit("/srv/house/"), F.when(i == 0, "").when(i == 1, "a/b/").when(i == 2, "skip/").when(i == 3, "a/b/c/d/").otherwise("../deep/x/y/z/"), "trace_id", F.lit(".jsonl"))
    files = D.sessions(spark, sf).select("trace_id", F.replace(path, F.lit("house/../"), F.lit("")).alias("path"), "mtime_ms")
    profiles = (scan.Profile("house", ("/srv/house",), exclude=("skip/*.jsonl",), max_depth=3), scan.Profile("house_deep", ("/srv/deep",), "pi"),
                scan.Profile("off", ("/srv",), enabled=False))
    return scan.discover(files, (), profiles).select("trace_id", "source_profile", "agent_hint")


@query(q("""SELECT trace_id, 'session' AS kind FROM sess WHERE CAST(trace_id AS BIGINT) % 3 <> 0 UNION ALL
  SELECT trace_id, 'diff' FROM sess WHERE CAST(trace_id AS BIGINT) % 3 = 0""", EVENTS, SESS))
def diff_placeholders(spark, sf):
    """A diff file stands for its session only where that has no file of its own (JN06)."""
    s = D.sessions(spark, sf).select("trace_id")
    at = lambda kind: F.concat(F.lit(f"/h/storage/{kind}/"), "trace_id", F.lit(".json"))
    files = s.filter(_C("trace_id").cast("bigint") % 3 != 0).select("trace_id", at("session/p").alias("path")).unionByName(s.select("trace_id", at("session_diff").alias("path")))
    return scan.without_superseded_diffs(files).select("trace_id", F.when(_C("path").contains("/session_diff/"), "diff").otherwise("session").alias("kind"))


@query(q("""SELECT event_id, CASE WHEN k % 2 = 0 THEN ts_ms ELSE ts_ms + 10 END AS created, ts_ms + 20 AS updated, CASE WHEN k % 3 = 0 THEN ts_ms + 30 ELSE ts_ms + 20 END AS completed,
  CASE WHEN k % 5 = 0 THEN ts_ms + 40 WHEN k % 2 = 0 THEN ts_ms ELSE ts_ms + 10 END AS started, CASE WHEN k % 7 = 0 THEN ts_ms + 50 WHEN k % 3 = 0 THEN ts_ms + 30 ELSE ts_ms + 20 END AS ended FROM ev""", EVENTS))
def merged_times(spark, sf):
    """Times of an exported row: its own JSON first, the row's columns where that has none (NO14)."""
    k, ts = _C("k"), _C("ts_ms")
    own = _S(F.when(k % 2 == 0, ts).alias("created"), F.when(k % 3 == 0, ts + 30).alias("completed"), F.when(k % 5 == 0, ts + 40).alias("start"), F.when(k % 7 == 0, ts + 50).alias("end"))
    e = D.events(spark, sf).select("event_id", F.try_parse_json(F.to_json(_S(own.alias("time")))).alias("v"), (ts + 10).alias("c"), (ts + 20).alias("u"))
    m = e.select("event_id", opencode.merged_time(_C("v"), _C("c"), _C("u")).alias("t"))
    return m.select("event_id", "t.created", "t.updated", "t.completed", _C("t.start").alias("started"), _C("t.end").alias("ended"))


@query(q("""SELECT trace_id, CASE WHEN CAST(trace_id AS BIGINT) % 7 = 0 THEN 'trace_added' ELSE 'trace_updated' END AS type FROM sess
  WHERE CAST(trace_id AS BIGINT) % 7 = 0 OR CAST(trace_id AS BIGINT) % 5 = 0""", EVENTS, SESS))
def summary_changes(spark, sf):
    """Stamped summaries: only what viewers see makes a change (SS14)."""
    s, i = D.sessions(spark, sf), _C("trace_id").cast("bigint")
    before = deltas.stamped(s.filter(i % 7 != 0))
    now = deltas.stamped(s.withColumns({"event_count": F.when(i % 5 == 0, _C("event_count") + 1).otherwise(_C("event_count")), "path": F.lit("elsewhere")}))
    return T.session_deltas(before.select("trace_id", "stamp"), now.select("trace_id", "stamp"))


@query(q("""SELECT event_id, ts_ms, CASE WHEN k % 3 = 0 THEN 'page' ELSE 'new' END AS origin FROM ev""", EVENTS))
def appended_pages(spark, sf):
    """A shown page with the latest events appended, each once; the page's own stay (SS13)."""
    e = D.events(spark, sf).select("event_id", "index", "ts_ms", "k")
    page = e.filter(_C("k") % 3 == 0).withColumn("origin", F.lit("page"))
    return deltas.append_to_page(page, e.filter(_C("k") % 6 != 3).withColumn("origin", F.lit("new"))).select("event_id", "ts_ms", "origin")
