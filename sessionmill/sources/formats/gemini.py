"""Gemini-style session documents (NO07): content parts, thoughts, tool calls with results, text last."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions import text as X
from ...functions import times, tools
from ...functions import variants as V
from ...functions.ids import session_id_document
from .common import by_class, chunks, or_tool, result_preview, texts, to_events, tool_preview

_EMPTY = "array<variant>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def _seed(kind: str, slot: Column, v: Column, **extra: Column) -> Column:
    nul = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("what"), slot.cast("bigint").alias("slot"), v.alias("iv"),
                    extra.get("rv", F.lit(None).cast("variant")).alias("rv"),
                    extra.get("no", F.lit(0)).cast("bigint").alias("no"), nul.alias("pad"))


def _results(call: Column, base: Column, no: Column) -> Column:
    """Result records of a tool call; a call without any keeps one empty record for its fallback text."""
    direct = F.when(V.has_keys(call, "$.functionResponse"), F.array(V.sub(call, "$.functionResponse"))).otherwise(_none())
    listed = F.transform(V.items(call, "$.result"), lambda i: F.when(V.has_keys(i, "$.functionResponse"),
                                                                     V.sub(i, "$.functionResponse")).otherwise(i))
    records = F.concat(direct, F.filter(listed, lambda r: V.has_keys(r, "$")))
    some = F.transform(records, lambda r, i: _seed("result", base + 1 + i, call, rv=r, no=no))
    return F.when(F.size(records) > 0, some).otherwise(F.array(_seed("result_text", base + 1, call, no=no)))


def row_blocks() -> Column:
    """Distinct texts of the row in column ``v`` in first-seen order (ST06): strings, item texts, part texts, nested blocks."""
    v = F.col("v")

    def content(path: str) -> Column:
        per_item = F.flatten(F.transform(V.items(v, path), lambda i: F.concat(
            F.array(V.text(i, "$.text")), F.transform(V.items(i, "$.parts"), lambda p: V.text(p, "$.text")))))
        return F.concat(per_item, V.text_blocks("v", path))
    own = F.array(*[F.when(V.is_string(V.sub(v, p)), V.text(v, p)).otherwise("") for p in ("$.message", "$.content", "$.text")])
    every = F.transform(F.concat(own, content("$.content"), content("$.message.content")), X.strip)
    return F.array_distinct(F.filter(every, lambda t: t != ""))


def normalize(rows: DataFrame) -> DataFrame:
    """``rows`` of ``scan.document_rows`` (or of the line reader, then without document id)."""
    v, c = F.col("v"), F.col
    typ = V.first_filled(F.lower(V.text(v, "$.type")), F.lit("message"))
    doc_id = c("doc_session_id") if "doc_session_id" in rows.columns else F.lit("")
    in_content = F.flatten(F.transform(V.items(v, "$.content"), lambda i: V.items(i, "$.parts")))
    parts = F.when(F.size(in_content) > 0, in_content).otherwise(V.items(v, "$.parts"))
    df = rows.withColumns({
        "ts_ms": times.guess_ts("v"), "typ": typ, "doc_id": doc_id, "parts": parts,
        "calls": V.items(v, "$.toolCalls"), "row_texts": row_blocks(),
        "thoughts": F.filter(F.transform(V.text_blocks("v", "$.thoughts"), X.strip), lambda t: t != ""),
        "rid": V.first_text(v, "$.id", "$.messageId", "$.message_id")})
    is_text = lambda p: ~V.has_keys(p, "$.functionCall") & ~V.has_keys(p, "$.functionResponse") & (X.strip(V.text(p, "$.text")) != "")
    spoken = F.exists("parts", is_text)
    typed = c("typ").isin("user", "gemini", "assistant", "model", "system")
    wants_text = (F.size("row_texts") > 0) | (typed & ~spoken & (F.size("calls") == 0))
    none = F.array().cast("array<struct<what:string,slot:bigint,iv:variant,rv:variant,no:bigint,pad:string>>")
    part_seeds = F.transform("parts", lambda p, i: F.when(V.has_keys(p, "$.functionCall"), _seed("call", i, p, no=i))
                             .when(V.has_keys(p, "$.functionResponse"), _seed("response", i, p, no=i))
                             .when(is_text(p), _seed("part", i, p, no=i)))
    call_seeds = F.flatten(F.transform("calls", lambda t, i: F.concat(
        F.array(_seed("use", F.lit(600) + i * 10, t, no=i)), _results(t, F.lit(600) + i * 10, i))))
    empty = F.parse_json(F.lit("{}"))
    seeds = F.concat(F.filter(part_seeds, lambda s: s.isNotNull()),
                     F.when(F.size("thoughts") > 0, F.array(_seed("thought", F.lit(500), empty))).otherwise(none), call_seeds,
                     F.when(wants_text, F.array(_seed("text", F.lit(900), empty))).otherwise(none))
    df = df.select("trace_id", "path", "row_no", "offset", "ts_ms", "raw_json", "typ", "doc_id", "rid", "row_texts", "thoughts",
                   "v", F.posexplode(seeds).alias("item_no", "s"))
    df = df.withColumns({"item_no": c("item_no").cast("bigint"), "iv": c("s.iv"), "rv": c("s.rv"), "what": c("s.what"),
                         "event_offset": c("offset") + c("s.slot")})
    # the JSON texts of an item once per row, the fields below look into them many times
    df = df.withColumns({"ij": F.to_json("iv"), "rj": F.to_json("rv")})
    iv, rv, what, ij, rj = c("iv"), c("rv"), c("what"), c("ij"), c("rj")
    jt = lambda x, *paths: X.compact(V.first_json_text(ij, x, *paths))
    role = F.when(c("typ").isin("gemini", "model", "assistant"), "assistant").otherwise(c("typ"))
    row_key = (c("row_no")).cast("string")
    by_call = what == "call"
    status = V.text(iv, "$.status")
    # record texts in order of preference, then the call's display text, then the record itself
    record = V.first_filled(*[X.compact(F.get_json_object(rj, f"$.{p}")) for p in ("response", "output", "result", "content")],
                            X.compact(F.get_json_object(ij, "$.resultDisplay")), X.compact(rj))
    fallback = V.first_filled(*[X.compact(F.get_json_object(ij, f"$.{p}")) for p in ("resultDisplay", "result", "response")], status)
    df = df.withColumns({
        "role": role,
        "name": F.when(by_call, or_tool(V.text(iv, "$.functionCall.name")))
        .when(what == "response", V.first_filled(V.text(iv, "$.functionResponse.name"), V.text(iv, "$.name")))
        .otherwise(or_tool(V.first_text(iv, "$.name", "$.function", "$.functionCall.name"))),
        "call": F.when(by_call, V.first_filled(V.first_text(iv, "$.functionCall.id", "$.id"), F.concat_ws(":", row_key, "s.no")))
        .when(what == "response", V.first_filled(V.first_text(iv, "$.functionResponse.id", "$.id"), F.concat_ws(":", row_key, "s.no")))
        .otherwise(V.first_filled(V.first_text(iv, "$.id", "$.call_id", "$.callId", "$.functionCall.id"),
                                  F.concat_ws(":", row_key, F.lit("tool"), "s.no"))),
        "args": F.when(by_call, jt(iv, "$.functionCall.args", "$.functionCall.arguments", "$.functionCall.input"))
        .otherwise(jt(iv, "$.args", "$.functionCall.args", "$.functionCall.arguments")),
        "res": F.when(what == "response", jt(iv, "$.functionResponse.response", "$.functionResponse.output", "$.functionResponse.result"))
        .when(what == "result", record).when(what == "result_text", fallback).otherwise(""),
        "err": F.when(what == "response", V.is_set(iv, "$.functionResponse.response.error") | V.is_set(iv, "$.functionResponse.error"))
        .when(what == "result", tools.status_is_error(status) | V.is_set(rv, "$.error") | V.is_set(rv, "$.response.error"))
        .otherwise(tools.status_is_error(status)),
        "own_ts": F.when(what.isin("use", "result_text"), times.guess_ts("iv"))
        .when(what == "result", F.coalesce(times.guess_ts("rv"), times.guess_ts("iv"))),
        "said": F.when(what == "part", X.strip(V.text(iv, "$.text"))).otherwise(X.compact(F.array_join("thoughts", "\n"))),
        "sid": F.when(c("doc_id") != "", c("doc_id")).otherwise("")})
    df = df.filter(~((what == "result_text") & (c("res") == "")))
    typ_of = tools.tool_type(c("name"), "gemini")
    head = F.coalesce(F.get("row_texts", F.lit(0)), F.lit(""))
    base = {"parent_event_id": c("rid"), "event_offset": c("event_offset")}
    tool_chunks = lambda last: chunks(c("typ"), c("role"), c("name"), c("call"), typ_of, last)
    classes = [
        ("use", what.isin("call", "use"), {
            **base, "event_ts_ms": c("own_ts"), "event_kind": "tool_use", "raw_type": F.when(by_call, "function_call").otherwise("tool_call"),
            "role": "assistant", "preview": tool_preview(c("name"), c("args")), "text_blocks": texts(c("args")), "tool_use_id": c("call"),
            "tool_name": c("name"), "tool_type": typ_of, "function_name": c("name"), "tool_args_text": c("args"),
            "toc_label": F.concat(F.lit("Tool: "), c("name")), "chunks": tool_chunks(c("args"))}),
        ("result", what.isin("response", "result", "result_text"), {
            **base, "event_ts_ms": c("own_ts"), "event_kind": "tool_result", "role": "assistant",
            "raw_type": F.when(what == "response", "function_response").otherwise("tool_result"),
            "preview": result_preview(c("res"), c("call")), "text_blocks": texts(c("res")), "tool_use_id": c("call"),
            "tool_name": c("name"), "tool_type": typ_of, "tool_result_text": c("res"), "has_error": c("err"),
            "toc_label": F.concat(F.lit("Result: "), or_tool(c("call"))), "chunks": tool_chunks(c("res"))}),
        ("part", what == "part", {
            **base, "event_kind": tools.kind_of_role(c("role")), "raw_type": c("typ"), "role": c("role"), "preview": X.preview(c("said")),
            "text_blocks": texts(c("said")), "chunks": chunks(c("typ"), c("role"), c("said"))}),
        ("thought", what == "thought", {
            **base, "event_kind": "reasoning", "raw_type": "thoughts", "role": "assistant", "preview": X.preview(c("said")),
            "text_blocks": texts(c("said")), "toc_label": "Thinking", "chunks": chunks(c("typ"), c("role"), c("said"))}),
        ("text", F.lit(True), {
            **base, "event_kind": tools.kind_of_role(c("role")), "raw_type": c("typ"), "role": c("role"),
            "preview": X.preview(V.first_filled(head, *[X.compact(F.get_json_object("raw_json", p)) for p in ("$.content", "$.message")],
                                                c("typ"))),
            "text_blocks": c("row_texts"), "chunks": chunks(c("typ"), c("role"), c("rid"), [c("row_texts")])}),
    ]
    return to_events(by_class(df, classes), ("first", F.col("sid")), session_id_document(F.col("path")))
