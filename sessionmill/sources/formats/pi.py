"""Pi-style JSON lines (NO08)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions import text as X
from ...functions import times, tools
from ...functions import variants as V
from ...functions.ids import session_id_suffix
from .common import by_class, chunks, explode_items, or_tool, result_preview, texts, to_events, tool_preview


def normalize(rows: DataFrame) -> DataFrame:
    v, c = F.col("v"), F.col
    rows = rows.withColumns({"ts_ms": times.guess_ts("v"), "typ": F.lower(X.strip(V.text(v, "$.type"))),
                             "role": F.lower(X.strip(V.text(v, "$.message.role")))})
    message = c("typ") == "message"
    tool_reply = message & (c("role") == "toolresult")
    df = explode_items(rows, "$.message.content", message & ~tool_reply)
    iv, ij, raw, item = c("iv"), c("ij"), c("raw_json"), c("has_item")
    msg_ts = F.coalesce(times.guess_ts("v", "$.message"), c("ts_ms"))
    df = df.withColumns({
        "sid": F.when(c("typ") == "session", X.strip(V.text(v, "$.id"))).otherwise(""),
        "parent": V.first_text(v, "$.parentId", "$.parent_id"), "mts": F.when(message, msg_ts),
        "itype": F.lower(X.strip(V.text(iv, "$.type"))), "own_id": session_id_suffix(c("path")),
        "blocks": F.when(item, V.item_blocks("iv")).otherwise(V.text_blocks("v", "$.message.content")),
        "call": V.first_text(v, "$.message.toolCallId", "$.message.tool_call_id"),
        "tname": V.first_text(v, "$.message.toolName", "$.message.tool_name"),
        "iname": or_tool(V.first_text(iv, "$.name", "$.toolName", "$.tool_name")),
        "iuse": V.first_text(iv, "$.id", "$.toolCallId", "$.tool_call_id"),
        "args": X.compact(V.first_json_text(ij, iv, "$.arguments", "$.args", "$.input")),
        "thinking": X.compact(V.first_json_text(ij, iv, "$.thinking", "$.text", "$.content")),
        "provider": V.text(v, "$.provider"), "model": V.first_text(v, "$.modelId", "$.model_id"),
        "level": V.first_text(v, "$.thinkingLevel", "$.thinking_level"), "cwd": V.text(v, "$.cwd"),
        "version": V.text(v, "$.version")})
    df = df.withColumns({
        "reply": X.compact(V.first_filled(F.array_join("blocks", "\n"), V.first_json_text(
            raw, v, "$.message.content", "$.message.output", "$.message.result", "$.message.error"))),
        "loose": F.when(item, X.compact(V.first_json_text(ij, iv, "$.text", "$.content")))
        .otherwise(X.compact(V.first_json_text(raw, v, "$.message.text", "$.message.content")))})
    df = df.withColumn("merged", F.when(F.size("blocks") > 0, c("blocks")).otherwise(texts(c("loose"))))
    head = F.coalesce(F.get("merged", F.lit(0)), F.lit(""))
    par, at_item = {"parent_event_id": c("parent")}, c("offset") + c("item_no")
    role = V.first_filled(c("role"), F.lit("assistant"))
    meta = {**par, "event_kind": "meta", "role": "system"}
    res_tt, use_tt = tools.tool_type(c("tname"), "pi"), tools.tool_type(c("iname"), "pi")
    # the session row itself names its session, an unnamed one keeps what was known before
    session_pv = X.preview(F.concat(F.lit("session: "), V.first_filled(c("sid"), c("own_id"), F.lit("session"))))
    level_pv = X.preview(F.concat(F.lit("thinking_level: "), V.first_filled(c("level"), F.lit("default"))))
    model_pv = X.preview(F.concat(F.lit("model_change: "), V.first_filled(c("model"), c("provider"), F.lit("model"))))
    of_bot = message & (c("role") == "assistant")
    timed = {"event_ts_ms": c("mts"), **par}
    classes = [
        ("session", c("typ") == "session", {
            **meta, "raw_type": c("typ"), "preview": session_pv, "text_blocks": texts(c("cwd"), c("version")),
            "chunks": chunks(c("typ"), V.first_filled(c("sid"), c("own_id")), c("cwd"), c("version"))}),
        ("model", c("typ") == "model_change", {
            **meta, "raw_type": c("typ"), "preview": model_pv, "text_blocks": texts(c("provider"), c("model")),
            "chunks": chunks(c("typ"), c("provider"), c("model"))}),
        ("level", c("typ") == "thinking_level_change", {
            **meta, "raw_type": c("typ"), "preview": level_pv, "text_blocks": texts(c("level")),
            "chunks": chunks(c("typ"), c("level"))}),
        ("other", ~message, {
            **meta, "raw_type": V.first_filled(c("typ"), F.lit("event")),
            "preview": X.preview(V.first_filled(c("typ"), F.lit("event"))), "chunks": chunks(c("typ"))}),
        ("reply", tool_reply, {
            **timed, "event_kind": "tool_result", "raw_type": c("role"), "role": "assistant",
            "preview": result_preview(c("reply"), c("call")),
            "text_blocks": F.when(c("reply") != "", F.array("reply")).otherwise(c("blocks")), "tool_use_id": c("call"),
            "tool_name": c("tname"), "tool_type": res_tt, "tool_result_text": c("reply"),
            "has_error": V.is_set(v, "$.message.isError") | V.is_set(v, "$.message.error"),
            "toc_label": F.concat(F.lit("Result: "), or_tool(c("call"))),
            "chunks": chunks(c("typ"), c("role"), c("tname"), c("call"), res_tt, c("reply"))}),
        ("whole", ~item, {
            **timed, "event_kind": tools.kind_of_role(c("role")), "raw_type": V.first_filled(c("role"), c("typ")),
            "role": role, "preview": X.preview(V.first_filled(head, c("role"), F.lit("message"))), "text_blocks": c("merged"),
            "event_offset": c("offset") + c("row_no") - 1, "chunks": chunks(c("typ"), c("role"), [c("merged")])}),
        ("think", of_bot & (c("itype") == "thinking"), {
            **timed, "event_kind": "reasoning", "raw_type": c("itype"), "role": "assistant", "event_offset": at_item,
            "preview": X.preview(V.first_filled(c("thinking"), F.lit("thinking"))), "text_blocks": texts(c("thinking")),
            "toc_label": F.when(c("thinking") != "", X.preview(c("thinking"))).otherwise("Thinking"),
            "chunks": chunks(c("typ"), c("role"), c("itype"), c("thinking"))}),
        ("use", of_bot & (c("itype") == "toolcall"), {
            **timed, "event_kind": "tool_use", "raw_type": c("itype"), "role": "assistant", "event_offset": at_item,
            "preview": tool_preview(c("iname"), c("args")), "text_blocks": texts(c("args")), "tool_use_id": c("iuse"),
            "tool_name": c("iname"), "tool_type": use_tt, "function_name": c("iname"), "tool_args_text": c("args"),
            "toc_label": F.concat(F.lit("Tool: "), c("iname")),
            "chunks": chunks(c("typ"), c("role"), c("itype"), c("iname"), c("iuse"), use_tt, c("args"))}),
        ("text", F.lit(True), {
            **timed, "event_kind": tools.kind_of_role(c("role")), "raw_type": V.first_filled(c("itype"), c("typ")),
            "role": role, "event_offset": at_item, "text_blocks": c("merged"),
            "preview": X.preview(V.first_filled(head, c("itype"), c("role"), c("typ"))),
            "chunks": chunks(c("typ"), c("role"), c("itype"), [c("merged")])}),
    ]
    return to_events(by_class(df, classes), ("last", F.col("sid")), session_id_suffix(F.col("path")), inherit=False)
