"""Codex-style JSON lines (NO03)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions import text as X
from ...functions import times, tools
from ...functions import variants as V
from .common import by_class, chunks, explode_items, or_tool, result_preview, texts, to_events, tool_preview


def normalize(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    rows = rows.withColumns({"ts_ms": times.guess_ts("v"), "typ": V.text(v, "$.type"),
                             "ptype": F.lower(V.text(v, "$.payload.type"))})
    response = F.col("typ") == "response_item"
    message = response & (F.col("ptype") == "message")
    df = explode_items(rows, "$.payload.content", message)
    c, raw, iv, ij = F.col, F.col("raw_json"), F.col("iv"), F.col("ij")
    item = F.col("has_item")
    pj = lambda *paths: X.compact(V.first_json_text(raw, v, *[f"$.payload.{p}" for p in paths]))
    df = df.withColumns({
        "sid": F.when(c("typ") == "session_meta", V.text(v, "$.payload.id")).otherwise(""),
        "parent": V.first_text(v, "$.parent_id", "$.parentId", "$.parent_event_id"),
        "role": V.first_filled(F.lower(V.text(v, "$.payload.role")), F.lit("assistant")),
        "call": V.first_text(v, "$.payload.call_id", "$.payload.id"),
        "tname": V.first_text(v, "$.payload.name", "$.payload.function", "$.payload.tool_name"),
        "itype": V.first_filled(F.lower(V.text(iv, "$.type")), c("ptype")),
        "blocks": F.when(item, V.item_blocks("iv")).otherwise(V.text_blocks("v", "$.payload.content")),
    })
    is_run, thinks = c("typ").startswith("item."), c("ptype").isin("reasoning", "thinking")
    df = df.withColumns({
        "iname": or_tool(V.first_filled(V.first_text(iv, "$.name", "$.function"), c("tname"))),
        "iuse": V.first_filled(V.first_text(iv, "$.id", "$.call_id", "$.tool_use_id"), c("call")),
        "ires": V.first_filled(V.first_text(iv, "$.tool_use_id", "$.call_id", "$.id"), c("call")),
        "iresname": V.first_filled(V.first_text(iv, "$.name"), c("tname")),
        "iargs": F.when(item, V.first_filled(X.compact(V.first_json_text(ij, iv, "$.arguments", "$.input", "$.params")),
                                pj("arguments", "input"))).otherwise(""),
        "ireply": F.when(item, V.first_filled(X.compact(V.first_json_text(ij, iv, "$.output", "$.content", "$.result")),
                                 pj("output", "result"))).otherwise(""),
        "pcall": F.when(c("ptype").startswith("custom_"), c("call"))
        .otherwise(V.first_filled(c("call"), V.text(v, "$.payload.tool_use_id"))),
        "pname": or_tool(V.first_filled(c("tname"), F.when(c("ptype") == "custom_tool_call", V.text(v, "$.payload.tool")))),
        "pargs": F.when(~response | message, "").when(c("ptype") == "custom_tool_call", pj("input", "arguments", "params"))
        .otherwise(pj("arguments", "input", "params")),
        "preply": F.when(response & ~message, pj("output", "result", "content")).otherwise(""),
        "ithink": F.when(item & c("itype").isin("reasoning", "thinking"), V.first_filled(tools.reasoning_text("iv", ij, "$.text", "$.content"),
                                 tools.reasoning_text("v", raw, "$.payload.summary"))).otherwise(""),
        "pthink": F.when(response & thinks, tools.reasoning_text("v", raw, "$.payload.summary", "$.payload.text", "$.payload.content")).otherwise(""),
        "command": F.when(is_run, X.compact(V.first_json_text(raw, v, "$.item.command", "$.item.args", "$.item.arguments"))).otherwise(""),
        "output": F.when(is_run, X.compact(V.first_json_text(raw, v, "$.item.aggregated_output", "$.item.output", "$.item.result"))).otherwise(""),
        "item_type": V.text(v, "$.item.type"), "item_id": V.first_text(v, "$.item.id", "$.item.call_id", "$.item.callId"),
        "compacted": X.strip(V.text(v, "$.payload.message")),
        "replaced": F.size(V.items(v, "$.payload.replacement_history")),
        "detail": F.when(c("typ") == "event_msg", X.compact(V.first_json_text(raw, v, "$.payload.message", "$.payload.info", "$.payload.summary",
                                              "$.payload.reason", "$.payload.details"))).otherwise(""),
    })
    shell = c("item_type") == "command_execution"
    df = df.withColumns({
        "item_tool": F.when(shell, "Bash").otherwise(or_tool(V.text(v, "$.item.name"))),
        "item_tt": tools.tool_type(F.when(shell, c("item_type")).otherwise(
            V.first_filled(V.first_text(v, "$.item.name"), c("item_type"))), "codex"),
        "history": F.when(c("replaced") > 0, F.concat(F.lit("replacement history entries: "), c("replaced"))).otherwise(""),
        "head": F.coalesce(F.get("blocks", F.lit(0)), F.lit("")),
    })
    at_item = c("offset") + c("item_no")
    par = {"parent_event_id": c("parent")}
    payload_id = V.text(v, "$.payload.id")
    meta_pv = X.preview(F.concat(F.lit("session_meta: "), V.first_filled(payload_id, F.lit("session"))))
    cwd, ver = V.text(v, "$.payload.cwd"), V.text(v, "$.payload.cli_version")
    itt, rtt = tools.tool_type(c("iname"), "codex"), tools.tool_type(c("iresname"), "codex")
    ptt, prtt = tools.tool_type(c("pname"), "codex"), tools.tool_type(c("tname"), "codex")
    action, query, url = V.text(v, "$.payload.action.type"), V.text(v, "$.payload.action.query"), V.text(v, "$.payload.action.url")
    action, status = F.lower(action), V.text(v, "$.payload.status")
    web = tools.web_tool_type(action)
    start, done = c("typ") == "item.started", c("typ").isin("item.completed", "item.finished")
    # a missing exit code is no number and counts as an error, an explicit null does not
    exit_v = V.sub(v, "$.item.exit_code")
    exit_ok = F.coalesce(F.to_json(exit_v) == "null", F.lit(False)) | F.coalesce(
        F.try_variant_get(v, "$.item.exit_code", "double") == 0, F.lit(False))
    use = lambda name, call, typ, args, raw_type, role, first: {
        **par, "event_kind": "tool_use", "raw_type": raw_type, "role": role, "preview": tool_preview(name, args),
        "text_blocks": texts(args), "tool_use_id": call, "tool_name": name, "tool_type": typ, "function_name": name,
        "tool_args_text": args, "toc_label": F.concat(F.lit("Tool: "), name),
        "chunks": chunks(c("typ"), c("ptype"), *first, name, call, typ, args)}
    reply = lambda name, call, typ, text, err, raw_type, role, parts, label: {
        **par, "event_kind": "tool_result", "raw_type": raw_type, "role": role, "preview": result_preview(text, call),
        "text_blocks": texts(text), "tool_use_id": call, "tool_name": name, "tool_type": typ, "tool_result_text": text,
        "has_error": err, "toc_label": F.concat(F.lit("Result: "), label), "chunks": chunks(c("typ"), c("ptype"), *parts)}
    p_err = V.is_set(v, "$.payload.is_error") | V.is_set(v, "$.payload.result.error")
    i_err = (V.is_set(iv, "$.is_error") | V.is_set(iv, "$.error") | V.is_set(v, "$.payload.tool_use_result.stderr")
             | V.is_set(v, "$.payload.result.error"))
    think = lambda text, raw_type, parts: {
        **par, "event_kind": "reasoning", "raw_type": raw_type, "role": "assistant",
        "preview": X.preview(V.first_filled(text, raw_type)), "text_blocks": texts(text), "toc_label": "Thinking",
        "chunks": chunks(c("typ"), c("ptype"), *parts, text)}
    role_kind = tools.kind_of_role(c("role"))
    classes = [
        ("session_meta", c("typ") == "session_meta", {
            **par, "event_kind": "meta", "raw_type": c("typ"), "role": "system", "preview": meta_pv,
            "text_blocks": texts(cwd, ver), "chunks": chunks(c("typ"), payload_id, cwd, ver)}),
        ("compacted", c("typ") == "compacted", {
            **par, "event_kind": "compaction", "raw_type": c("typ"), "role": "system",
            "preview": X.preview(V.first_filled(c("compacted"), c("history"), F.lit("Context compacted"))),
            "text_blocks": texts(c("compacted"), c("history")), "toc_label": "Context compacted",
            "chunks": chunks(c("typ"), "compaction", c("compacted"), c("history"))}),
        ("context_compacted", (c("typ") == "event_msg") & (c("ptype") == "context_compacted"), {
            **par, "event_kind": "compaction", "raw_type": c("ptype"), "role": "system",
            "preview": X.preview(V.first_filled(c("detail"), F.lit("Context compacted"))), "text_blocks": texts(c("detail")),
            "toc_label": "Context compacted", "chunks": chunks(c("typ"), c("ptype"), "compaction", c("detail"))}),
        ("message", message & ~item, {
            **par, "event_kind": role_kind, "raw_type": c("ptype"), "role": c("role"),
            "preview": X.preview(V.first_filled(c("head"), c("ptype"))), "text_blocks": c("blocks"),
            "chunks": chunks(c("typ"), c("ptype"), c("role"), [c("blocks")])}),
        ("item_use", message & c("itype").isin("tool_use", "function_call"), {
            **use(c("iname"), c("iuse"), itt, c("iargs"), c("itype"), "assistant", (c("itype"),)), "event_offset": at_item}),
        ("item_result", message & c("itype").isin("tool_result", "function_call_output"), {
            **reply(c("iresname"), c("ires"), rtt, c("ireply"), i_err, c("itype"), c("role"),
                    (c("itype"), c("role"), c("ires"), rtt, c("ireply")), or_tool(c("ires"))), "event_offset": at_item}),
        ("item_think", message & c("itype").isin("thinking", "reasoning"), {
            **think(c("ithink"), c("itype"), (c("itype"),)), "event_offset": at_item}),
        ("item_text", message, {
            **par, "event_kind": role_kind, "raw_type": c("itype"), "role": c("role"), "event_offset": at_item,
            "preview": X.preview(V.first_filled(c("head"), X.compact(V.first_json_text(ij, iv, "$.text", "$.content")),
                                                c("itype"))),
            "text_blocks": c("blocks"), "chunks": chunks(c("typ"), c("ptype"), c("itype"), c("role"), [c("blocks")])}),
        ("use", response & c("ptype").isin("function_call", "tool_use", "custom_tool_call"),
         use(c("pname"), c("pcall"), ptt, c("pargs"), c("ptype"), c("role"), ())),
        ("result", response & c("ptype").isin("function_call_output", "tool_result"),
         reply(c("tname"), c("pcall"), prtt, c("preply"), p_err, c("ptype"), c("role"),
               (c("pcall"), prtt, c("preply")), or_tool(c("pcall")))),
        ("custom_result", response & (c("ptype") == "custom_tool_call_output"),
         reply(c("tname"), c("pcall"), prtt, c("preply"), p_err, c("ptype"), c("role"),
               (c("pcall"), c("tname"), prtt, c("preply")), V.first_filled(c("pcall"), c("tname"), F.lit("tool")))),
        ("web", response & (c("ptype") == "web_search_call"), {
            **par, "event_kind": role_kind, "raw_type": c("ptype"), "role": c("role"), "text_blocks": texts(query, url),
            "preview": X.preview(V.first_filled(query, url, F.concat(
                c("ptype"), F.lit(": "), V.first_filled(action, status, F.lit("event"))))),
            "tool_type": web, "toc_label": F.when(action != "", F.concat(F.lit("Web: "), action)).otherwise("Web"),
            "chunks": chunks(c("typ"), c("ptype"), c("role"), status, action, web, query, url)}),
        ("think", response & c("ptype").isin("reasoning", "thinking"), think(c("pthink"), c("ptype"), ())),
        ("other", response, {
            **par, "event_kind": role_kind, "raw_type": V.first_filled(c("ptype"), c("typ")), "role": c("role"),
            "preview": X.preview(V.first_filled(c("head"), X.compact(V.first_filled(c("ptype"), c("typ"))))),
            "text_blocks": c("blocks"), "chunks": chunks(c("typ"), c("ptype"), c("role"), [c("blocks")])}),
        ("run", start | done, {
            **par, "event_kind": F.when(start, "tool_use").otherwise("tool_result"),
            "raw_type": V.first_filled(c("item_type"), c("typ")), "role": "assistant",
            "preview": X.preview(V.first_filled(c("command"), c("output"), c("item_tool"))),
            "text_blocks": texts(c("command"), c("output")), "tool_use_id": c("item_id"), "tool_name": c("item_tool"),
            "tool_type": c("item_tt"), "function_name": c("item_tool"),
            "tool_args_text": F.when(start, c("command")).otherwise(""),
            "tool_result_text": F.when(done, c("output")).otherwise(""), "has_error": ~exit_ok,
            "toc_label": F.concat(F.when(start, "Tool: ").otherwise("Result: "), c("item_tool")),
            "chunks": chunks(c("typ"), c("item_type"), c("command"), c("output"), c("item_tool"), c("item_tt"), c("item_id"))}),
        ("item_meta", c("typ").startswith("item."), {
            **par, "event_kind": "meta", "raw_type": c("typ"), "role": "system", "preview": X.preview(c("typ")),
            "chunks": chunks(c("typ"), c("item_type"))}),
        ("meta", F.lit(True), {
            **par, "event_kind": "meta", "raw_type": c("typ"), "role": "system",
            "preview": X.preview(V.first_filled(c("typ"), F.lit("event")))}),
    ]
    return to_events(by_class(df, classes), ("first", F.col("sid")))
