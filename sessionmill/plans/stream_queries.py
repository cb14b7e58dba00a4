"""The event sessions read as a file stream and drained; each must equal its batch twin."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as T
from ..operators.ordered import scratch_dir
from ..sources import scan
from ..streaming import aggregates as G
from ..streaming import invalidation as I
from ..streaming import live as L
from . import datasets as D
from .oracle import EVENTS, SEG, SESS, q
from .registry import query

_COLUMNS = ("trace_id", "index", "ts_ms", "agent", "event_kind", "has_error")
_SENTINEL = "sentinel"


def _stream(spark, sf, closing: bool):
    """Events as a stream over a copy of the adapted table. ``closing`` adds one far later row, which lets the watermark
    pass all others; it is dropped from the result."""
    path = scratch_dir(spark)
    e = D.events(spark, sf).select(*_COLUMNS)
    if closing:
        last = e.agg((F.max("ts_ms") + 10 * 86_400_000).alias("ts_ms"))
        e = e.unionByName(last.select(F.lit(_SENTINEL).alias("trace_id"), F.lit(-1).cast("bigint").alias("index"), "ts_ms",
                                      F.lit(_SENTINEL).alias("agent"), F.lit("meta").alias("event_kind"), F.lit(False).alias("has_error")))
    e.write.parquet(path)
    return G.file_events(spark, path, e.schema)


@query(q("SELECT trace_id, start_ms, end_ms, n_events FROM seg", EVENTS, SEG))
def stream_segments(spark, sf):
    out = G.drain(G.active_segments(G.with_event_time(_stream(spark, sf, True))), scratch_dir(spark))
    return out.filter(F.col("trace_id") != _SENTINEL).select("trace_id", "start_ms", "end_ms", "n_events")


@query(q("""SELECT ts_ms // 1800000 * 1800000 AS start_ms, agent, count(DISTINCT trace_id) AS sessions, count(*) AS events FROM ev
  GROUP BY 1, 2""", EVENTS))
def stream_bins(spark, sf):
    out = G.drain(G.activity_bins(G.with_event_time(_stream(spark, sf, True)), 30), scratch_dir(spark))
    return out.filter(F.col("agent") != _SENTINEL)


@query(q("""SELECT trace_id, event_count, error_count, tool_use_count, tool_result_count, first_ts_ms, last_ts_ms FROM sess""",
         EVENTS, SESS))
def stream_sessions(spark, sf):
    out = G.drain(G.session_summaries(_stream(spark, sf, False)), scratch_dir(spark), "complete")
    return out.select("trace_id", "event_count", "error_count", "tool_use_count", "tool_result_count", "first_ts_ms", "last_ts_ms")


_PARTS = 3   # the events in three parts by id, each one batch of the live stream
_LIVE = f"""cut AS (SELECT ev.*, seq * {_PARTS} // (SELECT max(seq) + 1 FROM ev) AS batch FROM ev),
upto AS (SELECT b.batch, c.* EXCLUDE (batch), c.batch AS own FROM (SELECT DISTINCT trace_id, batch FROM cut) b JOIN cut c ON c.trace_id = b.trace_id AND c.batch <= b.batch),
tools AS (SELECT batch, trace_id, count(*) FILTER (WHERE u AND NOT r) AS unmatched FROM (SELECT batch, trace_id, tool_use_id, bool_or(event_kind = 'tool_use') AS u,
  bool_or(event_kind = 'tool_result') AS r FROM upto WHERE tool_use_id <> '' GROUP BY ALL) GROUP BY ALL),
told AS (SELECT batch, trace_id, NOT arg_max(event_kind IN ('user', 'tool_use', 'tool_result'), seq) AS pending_wait FROM upto
  WHERE event_kind IN ('user', 'tool_use', 'tool_result') OR preview = '{D.WAIT_TEXT}' GROUP BY ALL),
now AS (SELECT batch, trace_id, count(*) AS event_count, count(*) FILTER (WHERE has_error) AS error_count, count(*) FILTER (WHERE event_kind = 'tool_use') AS tool_use_count,
  count(*) FILTER (WHERE event_kind = 'tool_result') AS tool_result_count, arg_min(ts_ms, seq) AS first_ts_ms, arg_max(ts_ms, seq) AS last_ts_ms,
  count(*) FILTER (WHERE own = batch) AS appended, list(event_id ORDER BY seq DESC) FILTER (WHERE own = batch)[1:40] AS newest, min(own) = batch AS fresh FROM upto GROUP BY batch, trace_id),
live AS (SELECT now.*, coalesce(unmatched, 0)::BIGINT AS unmatched_tool_uses, coalesce(pending_wait, false) AS pending_wait, list_reverse(newest) AS latest
  FROM now LEFT JOIN tools USING (batch, trace_id) LEFT JOIN told USING (batch, trace_id))"""
_LIVE_COLUMNS = "event_count, error_count, tool_use_count, tool_result_count, first_ts_ms, last_ts_ms, unmatched_tool_uses, pending_wait"


def _live(spark, sf):
    """The deltas of the event sessions after three drains; the rows of a part are written just before its own."""
    e = D.events(spark, sf).withColumn("is_wait", F.col("preview") == D.WAIT_TEXT)
    root, top = scratch_dir(spark), e.agg((F.max("index") + 1).alias("n"))
    parted = L.event_rows(e).crossJoin(F.broadcast(top)).withColumn("part", F.floor(F.col("index") * _PARTS / F.col("n")).cast("int")).drop("n")  # one row
    parted.write.partitionBy("part").parquet(f"{root}/parts")
    for i in range(_PARTS):
        spark.read.parquet(f"{root}/parts").filter(F.col("part") == i).drop("part").write.parquet(f"{root}/stream/{i}")
        sink = L.drain_live(spark.readStream.schema(L.EVENT).option("recursiveFileLookup", "true").parquet(f"{root}/stream"), root)
    return sink.deltas()


@query(q(f"""SELECT batch, trace_id, CASE WHEN fresh THEN 'trace_added' ELSE 'trace_updated' END AS type, NULL::BIGINT AS appended, '' AS latest, {_LIVE_COLUMNS} FROM live
 UNION ALL SELECT batch, trace_id, 'events_appended', appended, array_to_string(latest, ','), {_LIVE_COLUMNS} FROM live
 UNION ALL SELECT DISTINCT batch, '', 'overview_updated', NULL, '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM live""", EVENTS, _LIVE))
def stream_deltas(spark, sf):
    """The change feed of three batches, each from kept state and its own rows."""
    return _live(spark, sf).select(F.col("batch").cast("bigint").alias("batch"), "trace_id", "type", "appended", F.coalesce(F.array_join("latest", ","), F.lit("")).alias("latest"),
                                   *_LIVE_COLUMNS.split(", "))


@query(q("""SELECT trace_id, 'trace_added' AS type, NULL::BIGINT AS appended, '' AS latest FROM live GROUP BY ALL
 UNION ALL SELECT trace_id, 'events_appended', sum(appended)::BIGINT, array_to_string(flatten(list(latest ORDER BY batch)), ',') FROM live GROUP BY trace_id
 UNION ALL SELECT '', 'overview_updated', NULL, '' FROM (SELECT count(*) FROM live)""", EVENTS, _LIVE))
def stream_deltas_coalesced(spark, sf):
    """The same feed as one change per session and class, with the newest events of all its appends."""
    d = T.coalesced_deltas(_live(spark, sf).withColumn("payload", F.lit("")))
    return d.select("trace_id", "type", "appended", F.array_join("latest", ",").alias("latest"))


def _repaired(spark, sf, name):
    """Four fifths of the events on time, then one far later row that closes all of them, then the last fifth, all of it late."""
    root = scratch_dir(spark)
    e = D.events(spark, sf).select(*_COLUMNS)
    far = e.agg((F.max("ts_ms") + 10 * 86_400_000).alias("ts_ms")).select(F.lit(_SENTINEL).alias("trace_id"), F.lit(-1).cast("bigint").alias("index"), "ts_ms",
                                                                          F.lit(_SENTINEL).alias("agent"), F.lit("meta").alias("event_kind"), F.lit(False).alias("has_error"))
    fifth = F.pmod(F.xxhash64("index"), F.lit(5)) == 0
    kept = G.Repaired(spark, f"{root}/kept", e.schema, bin_minutes=30, kept=(name,), buckets=8)
    for i, part in enumerate((e.filter(~fifth), far, e.filter(fifth))):
        part.write.parquet(f"{root}/source/{i}")
        kept.advance(spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{root}/source"))
    return kept


@query(q("SELECT trace_id, start_ms, end_ms, n_events FROM seg", EVENTS, SEG))
def stream_segments_repaired(spark, sf):
    """Streamed segments with late rows folded in equal those of all rows."""
    return _repaired(spark, sf, "segments").segments.read().filter(F.col("trace_id") != _SENTINEL).select("trace_id", "start_ms", "end_ms", "n_events")


@query(q("""SELECT ts_ms // 1800000 * 1800000 AS start_ms, agent, count(DISTINCT trace_id) AS sessions, count(*) AS events FROM ev
  GROUP BY 1, 2""", EVENTS))
def stream_bins_repaired(spark, sf):
    """Streamed bins with late rows folded in equal those of all rows."""
    return _repaired(spark, sf, "bins").bins.read().filter(F.col("agent") != _SENTINEL)


def _files(t, version, turns):
    """Session, message and part files of the conversations: a part's text is its turn's, ``version`` says from which run."""
    c, sid, at = F.col, F.concat(F.lit("s"), "conv_id"), F.lpad(F.col("turn").cast("string"), 6, "0")
    mid, body = F.concat(F.lit("m"), "conv_id", F.lit("-"), at), lambda **x: F.to_json(F.struct(*[e.alias(n) for n, e in x.items()]))
    sessions = t.select("conv_id").distinct().select(F.concat(F.lit("storage/session/p/"), sid, F.lit(".json")).alias("name"), body(id=sid, title=F.concat(F.lit("T"), "conv_id")).alias("text"))
    rows = t.filter(turns)
    messages = rows.select(F.concat(F.lit("storage/message/"), sid, F.lit("/"), mid, F.lit(".json")).alias("name"),
                           body(id=mid, role=c("role"), time=F.struct((c("turn") * 1000 + 1_700_000_000_000).alias("created"))).alias("text"))
    parts = rows.select(F.concat(F.lit("storage/part/"), mid, F.lit("/p.json")).alias("name"),
                        body(id=F.lit("p"), type=F.lit("text"), text=F.concat(F.lit(f"{version} "), "role", F.lit(" "), F.length("text"))).alias("text"))
    return sessions, messages, parts


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'changed' ELSE 'first' END || ' ' || role || ' ' || length(text) AS txt,
  CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS kind FROM conversations WHERE turn % 4 <> 3 UNION ALL SELECT DISTINCT conv_id, -1, 'T' || conv_id, 'meta' FROM conversations)
SELECT 's' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, kind AS event_kind, txt AS text FROM t""")
def entity_refresh(spark, sf):
    """All conversations as files, twice: in the second run the parts of some turns have changed, the messages of others have come, and
    the parts of a third kind are without their message. Events are those of a fresh ingest."""
    t, root = D.table(spark, sf, "conversations").dropDuplicates(["conv_id", "turn"]), scratch_dir(spark)
    files, turn = f"{root}/files", F.col("turn") % 4
    kept = I.SessionFiles(spark, f"{root}/kept", buckets=16)
    first, second = _files(t, "first", turn < 2), _files(t, "changed", turn == 1)
    new = _files(t, "first", turn >= 2)
    late = _files(t, "first", turn == 2)
    # messages of turns 2 come in the second run, their parts are there from the first; turns 3 never get a message
    for run, some in enumerate(((*first, new[2]), (second[2], late[1]))):
        for rows in some:
            scan.write_files(rows, files)
        kept.refresh(scan.log_files(spark, [files]), run)
    return kept.read().select("session_id", "index", "event_kind", F.coalesce(F.get("text_blocks", F.lit(0)), F.lit("")).alias("text"))
