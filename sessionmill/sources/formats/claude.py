"""Claude-style JSON lines (NO02)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions import text as X
from ...functions import times, tools
from ...functions import variants as V
from .common import by_class, chunks, explode_items, or_tool, result_preview, texts, to_events, tool_preview


def normalize(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    typ = F.lower(V.text(v, "$.type"))
    rows = rows.withColumns({"ts_ms": times.guess_ts("v"), "typ": typ})
    is_msg = F.col("typ").isin("user", "assistant", "system")
    boundary = (F.col("typ") == "system") & (F.lower(V.text(v, "$.subtype")) == "compact_boundary")
    display = V.text(v, "$.display")
    history = (F.col("typ") == "") & (display != "")
    project = F.when(history, V.text(v, "$.project")).otherwise("")
    df = explode_items(rows, "$.message.content", is_msg & ~boundary)
    df = df.withColumn("sid", V.first_filled(V.first_text(v, "$.session_id", "$.sessionId"), project))

    raw, iv, ij, typ, item = F.col("raw_json"), F.col("iv"), F.col("ij"), F.col("typ"), F.col("has_item")
    role = F.lower(V.first_filled(V.first_text(v, "$.message.role"), typ))
    itype = V.first_filled(F.lower(V.text(iv, "$.type")), typ, F.lit("message"))
    parent = V.first_text(v, "$.parentUuid", "$.parent_uuid", "$.parent_event_id")
    uuid = V.first_filled(V.first_text(v, "$.uuid"), parent)
    parent_use = V.first_text(v, "$.parent_tool_use_id", "$.parentUuid")
    df = df.withColumns({
        "role": role, "itype": itype, "name": or_tool(V.first_filled(V.text(iv, "$.name"), V.text(iv, "$.tool_name"))),
        "use_id": V.first_text(iv, "$.id", "$.call_id", "$.tool_use_id"),
        "res_id": V.first_text(iv, "$.tool_use_id", "$.call_id", "$.id"),
        "res_name": V.first_text(iv, "$.name", "$.tool_name"),
        "args": X.compact(V.first_json_text(ij, iv, "$.input", "$.arguments", "$.params")),
        "blocks": F.when(item & (itype == "tool_result"), V.text_blocks("iv", "$.content"))
        .when(item, V.item_blocks("iv")).otherwise(V.text_blocks("v", "$.message.content")),
    })
    c = F.col
    head = F.coalesce(F.get("blocks", F.lit(0)), F.lit(""))
    result = X.compact(V.first_filled(F.array_join("blocks", "\n"),
                                      V.first_json_text(ij, iv, "$.content", "$.result", "$.output")))
    thinking = V.first_filled(
        *[F.when(~x.isin("", "{}", "[]"), x).otherwise("") for x in [X.compact(F.get_json_object(ij, "$.thinking"))]],
        X.compact(F.array_join("blocks", "\n")), X.compact(V.first_json_text(ij, iv, "$.text", "$.content")))
    compaction = V.first_filled(
        X.compact(F.get_json_object(raw, "$.content")),
        F.when(V.has_keys(v, "$.compactMetadata"), X.compact(F.get_json_object(raw, "$.compactMetadata"))),
        F.lit("Context compacted"))
    summary = V.first_filled(*[X.compact(F.get_json_object(raw, p)) for p in
                               ("$.summary", "$.message.content", "$.operation", "$.status")])
    df = df.withColumns({"result": result, "thinking": thinking})
    use_type, res_type = tools.tool_type(c("name"), "claude"), tools.tool_type(c("res_name"), "claude")
    error = (V.is_set(iv, "$.is_error") | V.is_set(iv, "$.error") | V.is_set(v, "$.toolUseResult.stderr")
             | V.is_set(v, "$.tool_use_result.stderr"))
    at_item = F.col("offset") + F.col("item_no")
    common = {"parent_tool_use_id": parent_use, "parent_event_id": uuid, "event_offset": at_item}
    plain = X.preview(V.first_filled(head, V.first_text(v, "$.message.id"), c("typ"), c("role")))
    text_pv = X.preview(V.first_filled(head, X.compact(V.first_json_text(ij, iv, "$.text", "$.content")), c("itype")))
    classes = [
        ("boundary", boundary, {
            "event_kind": "compaction", "raw_type": "compact_boundary", "role": "system", "preview": X.preview(compaction),
            "text_blocks": texts(compaction), "parent_event_id": parent, "toc_label": "Context compacted",
            "chunks": chunks(c("typ"), "compact_boundary", "compaction", compaction)}),
        ("whole", is_msg & ~item, {
            "event_kind": tools.kind_of_role(c("role")), "raw_type": c("typ"), "role": c("role"), "preview": plain,
            "text_blocks": c("blocks"), "parent_tool_use_id": parent_use, "parent_event_id": parent,
            "chunks": chunks(c("typ"), c("role"), V.text(v, "$.message.id"), [c("blocks")])}),
        ("use", is_msg & (c("itype") == "tool_use"), {
            **common, "event_kind": "tool_use", "raw_type": c("itype"), "role": "assistant",
            "preview": tool_preview(c("name"), c("args")), "text_blocks": texts(c("args")), "tool_use_id": c("use_id"),
            "tool_name": c("name"), "tool_type": use_type, "function_name": c("name"), "tool_args_text": c("args"),
            "toc_label": F.concat(F.lit("Tool: "), c("name")),
            "chunks": chunks(c("typ"), c("role"), c("itype"), c("name"), c("use_id"), use_type, c("args"))}),
        ("result", is_msg & (c("itype") == "tool_result"), {
            **common, "event_kind": "tool_result", "raw_type": c("itype"), "role": c("role"),
            "preview": result_preview(c("result"), c("res_id")),
            "text_blocks": F.when(c("result") != "", F.array("result")).otherwise(c("blocks")),
            "tool_use_id": c("res_id"), "tool_name": c("res_name"), "tool_type": res_type,
            "tool_result_text": c("result"), "has_error": error,
            "toc_label": F.concat(F.lit("Result: "), or_tool(c("res_id"))),
            "chunks": chunks(c("typ"), c("role"), c("itype"), c("res_id"), res_type, c("result"))}),
        ("think", is_msg & c("itype").isin("thinking", "redacted_thinking"), {
            **common, "event_kind": "reasoning", "raw_type": c("itype"), "role": "assistant",
            "preview": X.preview(V.first_filled(c("thinking"), F.lit("thinking"))), "text_blocks": texts(c("thinking")),
            "toc_label": F.when(c("thinking") != "", X.preview(c("thinking"))).otherwise("Thinking"),
            "chunks": chunks(c("typ"), c("role"), c("itype"), c("thinking"))}),
        ("text", is_msg, {
            "event_kind": tools.kind_of_role(c("role")), "raw_type": c("itype"), "role": c("role"), "preview": text_pv,
            "text_blocks": c("blocks"), "parent_tool_use_id": parent_use, "parent_event_id": parent,
            "event_offset": at_item, "chunks": chunks(c("typ"), c("role"), c("itype"), [c("blocks")])}),
        ("history", history, {
            "event_kind": "user", "raw_type": "history_entry", "role": "user", "preview": X.preview(display),
            "text_blocks": F.array(display), "chunks": chunks(display, V.text(v, "$.project"))}),
        ("meta", F.lit(True), {
            "event_kind": "meta", "raw_type": V.first_filled(c("typ"), F.lit("meta")), "role": "system",
            "preview": X.preview(V.first_filled(summary, c("typ"), F.lit("meta"))), "text_blocks": texts(summary),
            "parent_event_id": parent, "chunks": chunks(c("typ"), summary)}),
    ]
    return to_events(by_class(df, classes), ("first", F.col("sid")))
