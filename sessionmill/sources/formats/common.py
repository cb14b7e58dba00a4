"""Building blocks of the format jobs: seed columns, class-wise fields, event constructor, carried ids."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions import text as X
from ...functions import variants as V
from ...operators.ordered import running, staged
from ...schemas import EVENT_COLUMNS

# seed fields of an event; what a class does not set is derived in ``to_events``
SEED = ("event_kind", "raw_type", "role", "preview", "text_blocks", "tool_use_id", "parent_tool_use_id", "tool_name",
        "tool_type", "tool_call_id", "function_name", "tool_args_text", "tool_result_text", "parent_event_id",
        "toc_label", "has_error", "chunks")
_NO_TEXTS = "array<string>"
_TEXT_FIELDS = ("tool_use_id", "parent_tool_use_id", "tool_name", "tool_type", "function_name", "tool_args_text",
                "tool_result_text", "parent_event_id")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def texts(*cols) -> Column:
    """Array of the non-empty strings."""
    return F.filter(F.array(*[col(c) for c in cols]), lambda x: x != "")


def chunks(*parts) -> Column:
    """Search chunks: single strings, or lists holding one string array, in order; empty strings stay."""
    return F.concat(*[p[0] if isinstance(p, list) else F.array(col(p)) for p in parts])


def one(c) -> Column:
    return F.array(col(c))


def by_class(df: DataFrame, classes: list[tuple[str, Column, dict]]) -> DataFrame:
    """Seed columns picked by the first class whose condition holds; rows of no class are dropped."""
    name = F.coalesce(*[F.when(cond, F.lit(n)) for n, cond, _ in classes])
    df = df.withColumn("cls", name).filter("cls IS NOT NULL")
    out = {}
    for field in (*SEED, "event_offset", "event_ts_ms"):
        users = [(n, col(fields[field])) for n, _, fields in classes if field in fields]
        if users:
            e = F.when(F.col("cls") == users[0][0], users[0][1])
            for n, value in users[1:]:
                e = e.when(F.col("cls") == n, value)
        else:
            e = F.lit(None).cast({"text_blocks": _NO_TEXTS, "chunks": _NO_TEXTS, "has_error": "boolean",
                                  "event_offset": "bigint", "event_ts_ms": "bigint"}.get(field, "string"))
        out[f"s_{field}"] = e
    keep = [c for c in ("trace_id", "path", "row_no", "item_no", "offset", "ts_ms", "raw_json", "sid", "mtime_ms",
                        "event_model") if c in df.columns]
    return df.select(*keep, *[e.alias(n) for n, e in out.items()])


def to_events(seeds: DataFrame, session_id: tuple[str, Column] | None = None, fallback: Column | None = None,
              inherit: bool = True) -> DataFrame:
    """Event rows of the seeds (NO01), with running index, carried session id (NO10) and inherited tool type (NO11).

    The seeds are staged: the logs are parsed once, and the ordered passes read narrow columns of the staged table.
    ``session_id``: how the ``sid`` column is carried, ``first`` or ``last``; without it ``sid`` is taken as is.
    """
    seeds = staged(seeds)
    specs: dict = {"index": ("count", None)}
    if session_id:
        specs["carried"] = (session_id[0], F.nullif(session_id[1], F.lit("")))
    df = running(seeds, ["trace_id"], "row_no", specs, tie=["item_no"])
    base = fallback if fallback is not None else F.lit("")
    sid = F.coalesce(F.col("carried"), base) if session_id else F.coalesce("sid", base)
    s = lambda n: F.col(f"s_{n}")
    blocks = F.coalesce(s("text_blocks"), F.array().cast(_NO_TEXTS))
    preview = F.coalesce(s("preview"), X.preview(F.coalesce(F.get(blocks, F.lit(0)), V.first_filled(s("raw_type"), F.lit("event")))))
    search = F.coalesce(s("chunks"), F.concat(F.array(preview, s("raw_type")), blocks))
    offset = F.coalesce(s("event_offset"), F.col("offset"))
    ev = df.select(
        F.concat_ws(":", "trace_id", "index", offset).alias("event_id"), "trace_id", "index", offset.alias("offset"),
        F.coalesce(s("event_ts_ms"), F.col("ts_ms")).alias("ts_ms"), sid.alias("session_id"), s("event_kind").alias("event_kind"),
        s("raw_type").alias("raw_type"), F.coalesce(s("role"), F.lit("assistant")).alias("role"), preview.alias("preview"),
        blocks.alias("text_blocks"), *[F.coalesce(s(n), F.lit("")).alias(n) for n in _TEXT_FIELDS],
        F.coalesce(s("tool_call_id"), s("tool_use_id"), F.lit("")).alias("tool_call_id"),
        F.coalesce(s("toc_label"), preview).alias("toc_label"), F.coalesce(s("has_error"), F.lit(False)).alias("has_error"),
        F.lower(F.array_join(search, "\n")).alias("search_text"), "raw_json",
        *[c for c in ("event_model", "mtime_ms", "path", "row_no") if c in df.columns])
    if inherit:
        ev = inherit_tool_type(ev)
    extra = [c for c in ("event_model", "mtime_ms", "path", "row_no") if c in ev.columns]
    return ev.select(*EVENT_COLUMNS, *extra)


def inherit_tool_type(events: DataFrame) -> DataFrame:
    """A result without tool type takes the one of the latest earlier use with the same call id.

    The search text repeats the tool type, so it is amended too.
    """
    linked = F.col("event_kind").isin("tool_use", "tool_result") & (F.col("tool_call_id") != "")
    use_type = F.when(F.col("event_kind") == "tool_use", F.nullif(F.col("tool_type"), F.lit("")))
    carried = running(events.filter(linked), ["trace_id", "tool_call_id"], "index", {"seen": ("last", use_type)})
    lacks = (F.col("event_kind") == "tool_result") & (F.col("tool_type") == "") & F.col("seen").isNotNull()
    typ = F.when(lacks, F.col("seen")).otherwise(F.col("tool_type"))
    marked = F.concat(F.lit("\n"), F.lower("tool_call_id"), F.lit("\n"))
    search = F.when(lacks, F.replace(F.col("search_text"), F.concat(marked, F.lit("\n")),
                                     F.concat(marked, F.lower(F.col("seen")), F.lit("\n")))).otherwise(F.col("search_text"))
    done = carried.withColumns({"search_text": search, "tool_type": typ}).drop("seen")
    return done.select(*events.columns).unionByName(events.filter(~linked))


def explode_items(rows: DataFrame, path: str, wanted: Column) -> DataFrame:
    """One row per content item where ``wanted`` and the content is a filled array, else the row itself.

    Adds item_no, has_item, iv (variant, {} for odd items) and ij (JSON text in log order).
    """
    values = F.when(wanted, V.items(F.col("v"), path)).otherwise(F.array().cast("array<variant>"))
    df = rows.withColumn("__vals", values).withColumn(
        "__txts", F.when(F.size("__vals") > 0, V.item_texts(F.col("raw_json"), path)))
    empty = F.parse_json(F.lit("{}"))
    pairs = F.transform("__vals", lambda x, i: F.struct(
        F.when(V.is_object(x), x).otherwise(empty).alias("iv"),
        F.when(V.is_object(x), F.get("__txts", i)).otherwise(F.lit("{}")).alias("ij")))
    df = df.select(*rows.columns, F.posexplode_outer(pairs).alias("__pos", "__item"))
    return df.select(*rows.columns, F.coalesce("__pos", F.lit(0)).cast("bigint").alias("item_no"),
                     F.col("__pos").isNotNull().alias("has_item"), F.coalesce("__item.iv", empty).alias("iv"),
                     F.coalesce("__item.ij", F.lit("{}")).alias("ij"))


def tool_preview(name: Column, args: Column) -> Column:
    return X.preview(F.when(args != "", F.concat(name, F.lit(": "), args)).otherwise(F.concat(F.lit("tool "), name)))


def result_preview(text: Column, call_id: Column) -> Column:
    return X.preview(F.when(text != "", text).otherwise(F.trim(F.concat(F.lit("tool result "), call_id))))


def or_tool(c: Column) -> Column:
    return V.first_filled(c, F.lit("tool"))
