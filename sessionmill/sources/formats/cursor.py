"""Cursor-style transcripts: JSON lines or role-headed text with markers (NO04, NO05, NO12, NO13, SC06)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions import text as X
from ...functions import times, tools
from ...functions import variants as V
from ...functions.ids import session_id_plain
from ...operators.ordered import attach_by_chunk, running
from ..scan import json_rows, role_blocks
from .common import by_class, chunks, to_events


def session_metadata(meta: DataFrame) -> DataFrame:
    """(session_id, model, created_ms) from key/value rows; values may be hex of JSON. Key '0' wins."""
    value = F.trim("value")
    is_hex = value.rlike("^[0-9a-fA-F]+$") & (F.length(value) % 2 == 0)
    v = F.try_parse_json(F.when(is_hex, F.decode(F.unhex(F.when(is_hex, value)), "UTF-8")).otherwise(value))
    best = meta.withColumn("v", v).filter(V.is_object(F.col("v"))).groupBy("session_id").agg(
        F.min_by(F.struct("v"), F.struct((F.col("key") != "0").cast("int"), F.col("key"))).alias("m"))
    x = F.col("m.v")
    return best.select("session_id", V.first_filled(X.strip(V.text(x, "$.lastUsedModel")), X.strip(V.text(x, "$.model"))).alias("model"),
                       times.field_epoch_ms(x, "$.createdAt").alias("created_ms"))


def interpolated_ts(start_hint: Column, end_hint: Column, index: Column, count: Column) -> Column:
    """Time of the index-th of count events spread evenly over the span; an empty span counts up by 1 ms (NO12)."""
    start = F.coalesce(start_hint, end_hint)
    end = F.greatest(F.coalesce(end_hint, start), start)
    step = F.floor((end - start) * (index - 1) / F.greatest(count - 1, F.lit(1)) + 0.5)
    return F.when(start == end, start + index - 1).otherwise(start + step).cast("bigint")


def backfilled_model(kind: Column, own: Column, session_model: Column) -> Column:
    """Model of events that name none (NO13)."""
    fits = kind.isin("assistant", "reasoning", "tool_use", "tool_result")
    return F.when((F.trim(own) == "") & fits, F.coalesce(session_model, F.lit(""))).otherwise(own)


def finish(events: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Spreads the timestamps between creation and file time and fills in the session's model."""
    counts = events.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.first("session_id").alias("session_key"),
                                            F.max("mtime_ms").alias("end_ms"))
    if metadata is not None:
        counts = counts.join(metadata.withColumnRenamed("session_id", "session_key"), "session_key", "left")
    else:
        counts = counts.withColumns({"model": F.lit(""), "created_ms": F.lit(None).cast("bigint")})
    df = attach_by_chunk(events, counts, "trace_id", "index", "n")
    ts = interpolated_ts(F.col("created_ms"), F.col("end_ms"), F.col("index"), F.col("n"))
    model = backfilled_model(F.col("event_kind"), F.col("event_model"), F.col("model"))
    return df.withColumns({"ts_ms": ts, "event_model": model}).select(*events.columns)


def normalize_jsonl(line_rows: DataFrame) -> DataFrame:
    rows = json_rows(line_rows)
    v = F.col("v")
    role = F.lower(X.strip(V.text(v, "$.role")))
    rows = rows.withColumn("content", F.coalesce(V.sub(v, "$.message.content"), V.sub(v, "$.content")))
    blocks = V.text_blocks("content")
    fallback = V.first_filled(X.strip(V.text(v, "$.message.text")), X.strip(V.text(v, "$.text")))
    df = rows.withColumns({"role": role, "blocks": F.when(F.size(blocks) > 0, blocks).when(fallback != "", F.array(fallback))
                          .otherwise(F.array().cast("array<string>")), "item_no": F.lit(0).cast("bigint"),
                           "sid": session_id_plain(F.col("path")), "ts_ms": F.lit(None).cast("bigint"),
                           "event_model": V.text(v, "$.model")})
    c = F.col
    joined = X.strip(F.array_join("blocks", "\n"))
    kind = F.when(c("role") == "user", "user").otherwise("assistant")
    named = V.first_filled(c("role"), kind)
    return to_events(by_class(df, [("row", F.lit(True), {
        "event_kind": kind, "raw_type": F.concat(F.lit("cursor_jsonl_"), kind), "role": named,
        "preview": X.preview(V.first_filled(joined, c("role"), F.lit("cursor"))), "text_blocks": c("blocks"),
        "chunks": chunks(named, joined)})]), inherit=False)


def _joined(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of one text group put together in order. A group is one message of a transcript."""
    parts = lines.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("ls"), F.min("row_no").alias("first_row"))
    body = X.strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    return parts.withColumn("body", body).drop("ls")


def normalize_transcript(line_rows: DataFrame) -> DataFrame:
    """User blocks stay whole. In assistant blocks marker lines open thinking, tool calls and tool results; lines
    indented by two blanks and empty lines right after a call or result are its payload, others are speech."""
    lines = role_blocks(line_rows)
    key = ["trace_id", "path", "mtime_ms", "block_no", "role", "block_offset"]
    trimmed = X.strip(F.col("line"))
    said = lines.filter(trimmed != "").groupBy("trace_id", "block_no").agg(F.min("row_no").alias("first_text_row"))
    c = F.col
    user = _joined(lines.filter("role = 'user'"), key).filter("body <> ''").withColumns({
        "what": F.lit("user"), "name": F.lit(""), "marker_row": c("first_row"), "order": c("first_row"), "place": F.lit(0).cast("bigint")})
    bot = lines.filter("role = 'assistant'").join(said, ["trace_id", "block_no"])
    mark = F.lower(F.regexp_extract(trimmed, r"(?i)^\[(thinking|tool call|tool result)\]", 1))
    rest = F.regexp_extract(trimmed, r"(?i)^\[(?:thinking|tool call|tool result)\]\s*(.*)$", 1)
    bot = bot.withColumns({"mark": mark, "rest": rest, "blank": trimmed == "", "indented": c("line").rlike(r"^\s{2,}\S")})
    bot = running(bot, ["trace_id"], "row_no", {
        "open_row": ("last", F.when(F.col("mark") != "", F.col("row_no"))),
        "open_mark": ("last", F.when(F.col("mark") != "", F.col("mark"))),
        "open_rest": ("last", F.when(F.col("mark") != "", F.col("rest"))),
        "open_block": ("last", F.when(F.col("mark") != "", F.col("block_no"))),
        # the last line that ends a payload: speech that is neither blank nor indented
        "speech_row": ("last", F.when((F.col("mark") == "") & ~F.col("blank") & ~F.col("indented"), F.col("row_no")))})
    open_tool = (c("open_block") == c("block_no")) & c("open_mark").isin("tool call", "tool result")
    payload = (c("mark") == "") & F.coalesce(open_tool & (F.coalesce(c("speech_row"), F.lit(-1)) < c("open_row")), F.lit(False))
    bot = bot.withColumn("payload", payload).withColumn(
        "island", F.coalesce(F.when(c("open_block") == c("block_no"), c("open_row")), F.lit(0)))
    marks = bot.filter("mark <> ''").select(*key, "row_no", "first_text_row", F.col("mark").alias("what"), F.col("rest").alias("name"),
                                            F.col("row_no").alias("open_row"))
    details = _joined(bot.filter("payload").withColumn("line", F.when(F.col("blank"), "").otherwise(F.ltrim("line"))),
                      ["trace_id", "open_row"]).select("trace_id", "open_row", "body")
    marked = marks.join(details, ["trace_id", "open_row"], "left").fillna("", ["body"]).withColumns({
        "marker_row": c("row_no"), "order": c("row_no"), "place": c("row_no") - c("first_text_row")})
    speech = _joined(bot.filter("mark = '' AND NOT payload"), [*key, "island", "first_text_row"]).filter("body <> ''").withColumns({
        "what": F.lit("speech"), "name": F.lit(""), "marker_row": c("first_row"), "order": c("first_row"),
        "place": F.when(c("island") == 0, 0).otherwise(c("first_row") - c("first_text_row"))})
    cols = [*key, "what", "name", "body", "order", "place"]
    df = user.select(*cols).unionByName(marked.select(*cols)).unionByName(speech.select(*cols))
    # call ids: explicit, else the latest of the same tool, else made from the event number
    numbered = running(df.withColumnRenamed("order", "row_no"), ["trace_id"], "row_no", {"no": ("count", None)})
    explicit = F.nullif(X.call_id_in(F.col("body")), F.lit(""))
    is_call, is_result = c("what") == "tool call", c("what") == "tool result"
    numbered = numbered.withColumn("own_call", F.when(is_call, F.coalesce(explicit, F.concat(F.lit("cursor_tool_"), c("no"))))
                                   .when(is_result, explicit))
    numbered = numbered.withColumn("tool_key", F.when(is_call, F.lower(V.first_filled(c("name"), F.lit("tool"))))
                                   .when(is_result, F.lower("name")))
    calls = running(numbered.filter("tool_key <> ''"), ["trace_id", "tool_key"], "row_no", {
        "seen": ("last", F.when(F.col("what") == "tool call", F.col("own_call")))})
    numbered = calls.unionByName(numbered.filter("tool_key IS NULL OR tool_key = ''").withColumn("seen", F.lit(None).cast("string")))
    numbered = numbered.withColumns({
        "call": F.when(is_call, c("own_call")).when(is_result, F.coalesce("own_call", "seen", F.concat(F.lit("cursor_tool_result_"), c("no"))))
        .otherwise(""), "name": F.when(is_call, V.first_filled(c("name"), F.lit("tool"))).otherwise(c("name")),
        "query": X.tagged(c("body"), "user_query"), "thought": X.compact(c("name")),
        "sid": session_id_plain(c("path")), "item_no": F.lit(0).cast("bigint"), "ts_ms": F.lit(None).cast("bigint"),
        "offset": c("block_offset") + c("place"), "event_model": F.lit("")})
    tt = tools.tool_type(c("name"), "cursor")
    raw = F.to_json(F.struct(F.when(c("what") == "user", "user").otherwise("assistant").alias("role"), F.when(
        c("what").isin("thinking", "tool call", "tool result"), F.replace("what", F.lit(" "), F.lit("_"))).alias("marker"),
        F.when(c("what").isin("user", "speech"), c("body")).when(c("what") == "thinking", c("thought")).alias("text"),
        F.when(c("what") == "user", c("query")).alias("query"), F.when(is_call | is_result, c("name")).alias("toolName"),
        F.when(is_call | is_result, c("body")).alias("detailText"), F.when(is_call | is_result, c("call")).alias("toolCallId")))
    numbered = numbered.withColumn("raw_json", raw)
    body_texts = F.when(c("body") != "", F.array("body")).otherwise(F.array().cast("array<string>"))
    classes = [
        ("user", c("what") == "user", {
            "event_kind": "user", "raw_type": "cursor_user", "role": "user", "preview": X.preview(V.first_filled(c("query"), c("body"))),
            "text_blocks": body_texts, "chunks": chunks("user", c("query"), c("body"))}),
        ("thinking", c("what") == "thinking", {
            "event_kind": "reasoning", "raw_type": "thinking", "role": "assistant",
            "preview": X.preview(V.first_filled(c("thought"), F.lit("thinking"))),
            "text_blocks": F.when(c("thought") != "", F.array("thought")).otherwise(F.array().cast("array<string>")),
            "toc_label": F.when(c("thought") != "", X.preview(c("thought"))).otherwise("Thinking"), "chunks": chunks("thinking", c("thought"))}),
        ("call", is_call, {
            "event_kind": "tool_use", "raw_type": "tool_call", "role": "assistant", "text_blocks": body_texts,
            "preview": X.preview(F.when(c("body") != "", F.concat_ws(": ", "name", "body")).otherwise(c("name"))),
            "tool_use_id": c("call"), "tool_name": c("name"), "tool_type": tt, "function_name": c("name"), "tool_args_text": c("body"),
            "toc_label": F.concat(F.lit("Tool: "), c("name")), "chunks": chunks("tool call", c("name"), tt, c("body"))}),
        ("result", is_result, {
            "event_kind": "tool_result", "raw_type": "tool_result", "role": "assistant", "text_blocks": body_texts,
            "preview": X.preview(F.when(c("body") != "", c("body")).otherwise(F.concat(V.first_filled(c("name"), F.lit("tool")), F.lit(" result")))),
            "tool_use_id": c("call"), "tool_name": c("name"), "tool_type": tt, "tool_result_text": c("body"),
            "toc_label": F.concat(F.lit("Result: "), V.first_filled(c("name"), F.lit("tool"))),
            "chunks": chunks("tool result", c("name"), tt, c("body"))}),
        ("speech", F.lit(True), {
            "event_kind": "assistant", "raw_type": "cursor_assistant", "role": "assistant", "preview": X.preview(c("body")),
            "text_blocks": body_texts, "chunks": chunks("assistant", c("body"))}),
    ]
    return to_events(by_class(numbered, classes), inherit=False)


def normalize(line_rows: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Events of transcript files; a file with any JSON row is read as JSON lines, every other as text."""
    jsonl = json_rows(line_rows).select("trace_id").distinct()
    as_json = normalize_jsonl(line_rows)
    as_text = normalize_transcript(line_rows.join(jsonl, "trace_id", "left_anti"))
    return finish(as_json.unionByName(as_text), metadata)
