"""Multi-file sessions: session, message and part entities (NO06, NO14, JN05, JN07, SC05).

Every entity set is a table (key, owner, path, raw_json, v) as ``scan.entities`` gives it, or an export of the same
shape. Messages and parts meet their session by equi joins.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions import text as X
from ...functions import times, tools
from ...functions import variants as V
from .common import by_class, chunks, or_tool, texts, to_events, tool_preview


def merged_time(v: Column, created: Column, updated: Column) -> Column:
    """Time fields of an exported row: its own JSON first, the row's columns where the JSON has none."""
    t = lambda n: times.field_epoch_ms(v, f"$.time.{n}")
    return V.let(F.struct(F.coalesce(t("created"), created).alias("created"), F.coalesce(t("updated"), updated).alias("updated")),
                 lambda a: V.let(F.coalesce(t("completed"), a["updated"]), lambda done: F.struct(
                     a["created"].alias("created"), a["updated"].alias("updated"), done.alias("completed"),
                     F.coalesce(t("start"), a["created"]).alias("start"),
                     F.coalesce(t("end"), done, a["updated"]).alias("end"))))


def part_time(v: Column, fallback: Column, prefer_end: bool) -> Column:
    t = lambda n: times.field_epoch_ms(v, f"$.time.{n}")
    order = ("end", "start", "created") if prefer_end else ("start", "created", "end")
    return F.coalesce(*[t(n) for n in order], fallback)


def overlay_sessions(files: DataFrame, exported: DataFrame) -> DataFrame:
    """Session fields from the file, filled up from the exported session row of the same id (JN07).

    Both have session_id and the plain columns below; ``time`` is merged key by key.
    """
    names = ("title", "version", "slug", "directory", "project_id", "created_ms", "updated_ms")
    f, e = files.alias("f"), exported.alias("e")
    return f.join(e, F.col("f.session_id") == F.col("e.session_id"), "left").select(
        *[f"f.{c}" for c in files.columns if c not in names], *[F.coalesce(f"f.{n}", f"e.{n}").alias(n) for n in names])


def session_fields(sessions: DataFrame) -> DataFrame:
    v = F.col("v")
    t = lambda p: F.nullif(X.strip(V.text(v, p)), F.lit(""))
    return sessions.select(
        "trace_id", "path", "mtime_ms", V.first_filled(F.coalesce(t("$.id"), F.lit("")), F.col("key")).alias("session_id"),
        t("$.title").alias("title"), t("$.version").alias("version"), t("$.slug").alias("slug"),
        t("$.directory").alias("directory"), t("$.projectID").alias("project_id"),
        times.field_epoch_ms(v, "$.time.created").alias("created_ms"), times.field_epoch_ms(v, "$.time.updated").alias("updated_ms"))


def of_session(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages of the sessions; a message that names another session than its directory is dropped, a blank is fine."""
    own = X.strip(V.text(F.col("m.v"), "$.sessionID"))
    joined = rows.alias("m").join(sessions.select("trace_id", "session_id").alias("s"), F.col("m.owner") == F.col("s.session_id"))
    return joined.filter((own == "") | (own == F.col("s.session_id"))).select("s.trace_id", "s.session_id", "m.*")


def prefer_files(from_files: DataFrame, exported: DataFrame, key: str = "session_id") -> DataFrame:
    """Exported rows stand in only for sessions without any file rows (SC05)."""
    have = from_files.select(key).distinct()
    return from_files.unionByName(exported.join(have, key, "left_anti"))


def normalize(sessions: DataFrame, messages: DataFrame, parts: DataFrame, exported_messages: DataFrame | None = None,
              exported_parts: DataFrame | None = None) -> DataFrame:
    s = session_fields(sessions) if "session_id" not in sessions.columns else sessions
    msgs = of_session(messages, s)
    if exported_messages is not None:
        msgs = prefer_files(msgs, of_session(exported_messages, s))
        parts = parts.unionByName(exported_parts) if exported_parts is not None else parts
    mv = F.col("v")
    msgs = msgs.select("trace_id", F.col("session_id").alias("sess"), X.strip(V.text(mv, "$.id")).alias("mid"),
                       F.col("raw_json").alias("mj"), F.col("v").alias("mv"),
                       F.coalesce(times.field_epoch_ms(mv, "$.time.created"), F.lit(0)).alias("m_order"))
    own = X.strip(V.text(F.col("p.v"), "$.sessionID"))
    joined = msgs.alias("m").join(parts.alias("p"), (F.col("m.mid") == F.col("p.owner"))
                                  & ((own == "") | (own == F.col("m.sess"))), "left").select(
        "m.*", F.col("p.path").alias("part_path"), F.col("p.raw_json").alias("pj"), F.col("p.v").alias("pv"))
    heads = s.withColumns({"m_order": F.lit(-1).cast("bigint"), "mid": F.lit(""), "part_path": F.lit(""), "sess": F.col("session_id")})
    base = joined.join(s.select("trace_id", "path", "mtime_ms", "directory", "title", "version", "slug", "project_id",
                                "created_ms", "updated_ms"), "trace_id")
    df = base.unionByName(heads.drop("session_id"), allowMissingColumns=True)
    mv, pv, pj, c = F.col("mv"), F.col("pv"), F.col("pj"), F.col
    is_head, has_part = c("mv").isNull(), c("pv").isNotNull()
    m_created, m_done = times.field_epoch_ms(mv, "$.time.created"), times.field_epoch_ms(mv, "$.time.completed")
    pt = lambda p: V.text(pv, f"$.{p}")
    df = df.withColumns({
        "role": F.lower(X.strip(V.text(mv, "$.role"))), "parent": X.strip(V.text(mv, "$.parentID")),
        "msid": V.first_filled(X.strip(V.text(mv, "$.sessionID")), c("sess")), "m_created": m_created,
        "ptype": F.lower(X.strip(pt("type"))), "pid": X.strip(pt("id")),
        "t_start": part_time(pv, F.coalesce(m_created, c("created_ms")), False),
        "t_end": part_time(pv, F.coalesce(m_done, m_created, c("updated_ms")), True),
        "status": F.lower(X.strip(pt("state.status"))), "ttitle": X.strip(pt("state.title")),
        "tool": or_tool(pt("tool")), "ptext": pt("text"),
        "args": X.compact(V.first_json_text(pj, pv, "$.state.input", "$.state.raw")),
        "bad": X.compact(V.first_json_text(pj, pv, "$.state.error", "$.state.output", "$.state.metadata")),
        "good": X.compact(V.first_json_text(pj, pv, "$.state.output", "$.state.metadata", "$.state.title"))})
    df = df.withColumns({"call": V.first_filled(pt("callID"), c("pid"), c("mid")),
                         "res": F.when(c("status") == "error", c("bad")).otherwise(c("good"))})
    # a finished tool part gives two events, everything else one
    answered = (c("ptype") == "tool") & c("status").isin("completed", "error")
    df = df.withColumn("half", F.explode(F.when(F.coalesce(answered, F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    tt = tools.tool_type(c("tool"), "opencode")
    n = lambda p: F.coalesce(F.try_variant_get(pv, f"$.tokens.{p}", "double"), F.lit(0.0))
    tokens = F.when(V.has_keys(pv, "$.tokens"), X.token_summary(
        n("input"), n("output"), n("reasoning"), n("cache.read"), n("cache.write"), F.try_variant_get(pv, "$.tokens.total", "double"))).otherwise("")
    cost_v = F.try_variant_get(pv, "$.cost", "double")
    cost = F.coalesce(F.concat(F.lit("cost: "), F.format_string("%.6f", cost_v)), F.lit(""))
    label = lambda prefix, *xs: X.preview(F.concat(F.lit(prefix), V.first_filled(*xs)))
    kind_pv = {
        "step-start": F.lit("Step started"),
        "step-finish": F.when(pt("reason") != "", label("Step finished: ", pt("reason"))).otherwise("Step finished"),
        "patch": F.when(X.strip(pt("hash")) != "", label("Patch: ", X.strip(pt("hash")))).otherwise("Patch"),
        "snapshot": F.lit("Snapshot"),
        "file": label("", pt("filename"), pt("url"), F.lit("File attachment")),
        "subtask": label("Subtask: ", pt("description"), pt("prompt")),
        "agent": label("Agent: ", pt("name"), F.lit("agent")),
        "retry": label("Retry: ", pt("error.message"), pt("attempt")), "compaction": F.lit("Compaction")}
    files = F.filter(F.transform(V.items(pv, "$.files"), lambda f: V.text(f)), lambda t: t != "")
    kind_texts = {
        "step-start": texts(pt("snapshot")), "step-finish": texts(pt("reason"), tokens, cost, pt("snapshot")),
        "patch": F.concat(F.array(pt("hash")), files), "file": texts(pt("mime"), pt("url"), pt("filename")),
        "subtask": texts(pt("prompt"), pt("description"), pt("agent")), "agent": texts(pt("name")),
        "retry": texts(pt("attempt"), pt("error.message")), "compaction": texts(pt("auto")), "snapshot": texts(pt("snapshot"))}
    whole = X.compact(pj)
    meta_pv = X.preview(V.first_filled(c("ptype"), whole, F.lit("meta")))
    meta_tx = texts(whole)
    for k in kind_pv:
        meta_pv = F.when(c("ptype") == k, kind_pv[k]).otherwise(meta_pv)
        meta_tx = F.when(c("ptype") == k, kind_texts[k]).otherwise(meta_tx)
    df = df.withColumns({"meta_pv": meta_pv, "meta_tx": meta_tx})
    of_user = c("role") == "user"
    bare = F.when(c("role") == "assistant", V.first_filled(V.text(mv, "$.finish"), V.text(mv, "$.modelID"), c("mid"), F.lit("assistant message"))) \
        .otherwise(V.first_filled(V.text(mv, "$.summary.title"), c("mid"), F.lit("user message")))
    s_texts = [F.coalesce(c(x), F.lit("")) for x in ("directory", "title", "version")]
    diff = F.lower(F.replace("path", F.lit("\\"), F.lit("/"))).contains("/storage/session_diff/")
    ids = lambda *more: chunks(c("role"), c("mid"), c("pid"), c("ptype"), *more)
    title_or_args = F.when(c("args") != "", F.array("args")).otherwise(texts(c("ttitle")))
    par = {"parent_event_id": c("parent")}
    classes = [
        ("head", is_head, {
            "event_kind": "meta", "raw_type": F.when(diff, "session_diff_meta").otherwise("session_meta"), "role": "system",
            "event_ts_ms": F.coalesce("created_ms", "updated_ms"), "text_blocks": texts(*s_texts), "toc_label": "Session metadata",
            "preview": X.preview(F.concat(F.lit("session_meta: "), V.first_filled(c("sess"), F.lit("session")))),
            "chunks": chunks("session_meta", c("sess"), *[F.coalesce(c(x), F.lit("")) for x in (
                "slug", "directory", "title", "project_id", "version")])}),
        ("bare", ~has_part, {
            **par, "event_kind": tools.kind_of_role(c("role")), "raw_type": "message", "role": V.first_filled(c("role"), F.lit("assistant")),
            "event_ts_ms": F.coalesce("m_created", "updated_ms"), "preview": X.preview(bare),
            "chunks": chunks(c("role"), c("mid"), X.preview(bare))}),
        ("text", c("ptype") == "text", {
            **par, "event_kind": F.when(of_user, "user").otherwise("assistant"), "raw_type": "text", "role": V.first_filled(c("role"), F.lit("assistant")),
            "event_ts_ms": c("t_start"), "text_blocks": texts(c("ptext")),
            "preview": X.preview(V.first_filled(c("ptext"), F.concat(V.first_filled(c("role"), F.lit("assistant")), F.lit(" text")))),
            "chunks": ids(c("ptext"))}),
        ("reasoning", c("ptype") == "reasoning", {
            **par, "event_kind": "reasoning", "raw_type": "reasoning", "role": "assistant", "event_ts_ms": c("t_start"),
            "preview": X.preview(V.first_filled(c("ptext"), F.lit("thinking"))), "text_blocks": texts(c("ptext")),
            "toc_label": "Thinking", "chunks": ids(c("ptext"))}),
        ("use", (c("ptype") == "tool") & (c("half") == 0), {
            **par, "event_kind": "tool_use", "raw_type": "tool", "role": "assistant", "event_ts_ms": c("t_start"),
            "preview": F.when((c("args") == "") & (c("ttitle") != ""), X.preview(c("ttitle"))).otherwise(tool_preview(c("tool"), c("args"))),
            "text_blocks": title_or_args, "tool_use_id": c("call"), "tool_name": c("tool"), "tool_type": tt, "function_name": c("tool"),
            "tool_args_text": c("args"), "toc_label": F.concat(F.lit("Tool: "), c("tool")),
            "chunks": ids(c("tool"), c("call"), tt, c("args"), c("status"), c("ttitle"))}),
        ("result", c("ptype") == "tool", {
            **par, "event_kind": "tool_result", "raw_type": "tool", "role": "assistant", "event_ts_ms": F.coalesce("t_end", "t_start"),
            "preview": X.preview(V.first_filled(c("res"), F.concat(F.lit("tool result "), c("call")))), "text_blocks": texts(c("res")),
            "tool_use_id": c("call"), "tool_name": c("tool"), "tool_type": tt, "tool_result_text": c("res"),
            "has_error": c("status") == "error", "toc_label": F.concat(F.lit("Result: "), c("call")),
            "chunks": ids(c("tool"), c("call"), tt, c("res"), c("status"))}),
        ("meta", F.lit(True), {
            **par, "event_kind": "meta", "raw_type": V.first_filled(c("ptype"), F.lit("meta")), "role": "system",
            "event_ts_ms": F.coalesce("t_end", "t_start"), "preview": c("meta_pv"), "text_blocks": c("meta_tx"),
            "chunks": ids(c("meta_pv"), [c("meta_tx")])}),
    ]
    raw = F.when(is_head, F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(
        c("sess").alias("id"), *[F.coalesce(c(a), F.lit("")).alias(b) for a, b in (
            ("directory", "cwd"), ("title", "title"), ("version", "version"), ("slug", "slug"), ("project_id", "project_id"))],
        c("updated_ms").alias("updated"), c("created_ms").alias("created")).alias("payload")))) \
        .otherwise(F.concat(F.lit('{"message":'), c("mj"), F.coalesce(F.concat(F.lit(',"part":'), pj), F.lit("")), F.lit("}")))
    df = df.withColumns({"raw_json": raw, "sid": c("msid"), "row_no": c("m_order"), "ts_ms": F.lit(None).cast("bigint"),
                         "offset": F.lit(0).cast("bigint"), "item_no": F.struct("mid", "part_path", "half")})
    ev = to_events(by_class(df, classes), inherit=False)
    return ev.withColumn("offset", F.col("index") - 1).withColumn("event_id", F.concat_ws(":", "trace_id", "index", "offset")) \
        .select(*ev.columns)
