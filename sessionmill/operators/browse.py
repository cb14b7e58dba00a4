"""Finding, sorting and paging sessions and events (FI01-FI13, FI15, SO01-SO10, JN15)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..functions import variants as V
from ..schemas import DAY_MS
from .ordered import global_rank, ranked, running


def updated() -> Column:
    return F.coalesce("last_ts_ms", "mtime_ms")


def by_recency() -> list[Column]:
    return [updated().desc(), F.asc("path"), F.asc("trace_id")]


def by_mtime() -> list[Column]:
    return [F.desc("mtime_ms"), F.asc("path")]


def clamp_limit(limit: int | None, default: int = 50) -> int:
    return max(1, min(5000, default if limit is None else limit))


def of_agent(sessions: DataFrame, agent: str | None) -> DataFrame:
    return sessions if not agent else sessions.filter(F.col("agent") == agent.strip().lower())


def since(sessions: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    return sessions.filter(updated() >= now_ms - window_ms)


def without_meta(events: DataFrame) -> DataFrame:
    return events.filter("event_kind <> 'meta'")


def of_kinds(events: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return without_meta(events) if kinds is None else events.filter(F.col("event_kind").isin(kinds))


def search_sessions(sessions: DataFrame, text: str) -> DataFrame:
    """Sessions whose path, agent, session id or trace id contains the text, case aside."""
    needle = text.strip().lower()
    hay = F.lower(F.concat_ws("\n", "path", "agent", "session_id", "trace_id"))
    return sessions if not needle else sessions.filter(F.contains(hay, F.lit(needle)))


def search_events(events: DataFrame, text: str) -> DataFrame:
    return events.filter(F.contains("search_text", F.lit(text.strip().lower())))


def contents(events: DataFrame) -> DataFrame:
    """Table of contents rows of events."""
    return events.select("trace_id", "event_id", "index", "ts_ms", "event_kind",
                         V.first_filled(F.col("toc_label"), F.col("preview")).alias("label"),
                         F.col("event_kind").alias("color_key"), "tool_type")


def search_contents(toc: DataFrame, text: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", F.col("index").cast("string"), "event_kind", "tool_type", "label"))
    return toc.filter(F.contains(hay, F.lit(text.strip().lower())))


def recent_sessions(sessions: DataFrame, agent: str | None = None, limit: int | None = None) -> DataFrame:
    return of_agent(sessions, agent).orderBy(*by_mtime()).limit(clamp_limit(limit))


def candidate_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(*by_recency()).limit(limit)


def history_rows(sessions: DataFrame, limit: int = 50, start_rank: int = 1) -> DataFrame:
    """Ranked listing of the newest sessions. The window sees at most ``limit`` rows."""
    top = sessions.orderBy(*by_recency()).limit(clamp_limit(limit))
    rank = F.row_number().over(W.orderBy(*by_recency())) + (start_rank - 1)
    return top.select(rank.cast("bigint").alias("rank"), V.first_filled(F.col("session_id"), F.lit("-")).alias("session_id"),
                      "trace_id", "agent", updated().alias("updated_ms"), "event_count", "error_count", "tool_use_count",
                      *(["activity_status"] if "activity_status" in sessions.columns else []),
                      X.path_tail(F.col("path")).alias("path_tail"))


def recency_buckets(sessions: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """Sessions as today / last_7d / older, ranks running on over the buckets; with a limit only the newest ones."""
    age = F.greatest(F.lit(now_ms) - updated(), F.lit(0))
    bucket = F.when(age < DAY_MS, "today").when(age < 7 * DAY_MS, "last_7d").otherwise("older")
    order = F.when(age < DAY_MS, 0).when(age < 7 * DAY_MS, 1).otherwise(2)
    top = sessions if limit is None else sessions.orderBy(*by_recency()).limit(clamp_limit(limit))
    top = top.withColumns({"bucket": bucket, "o": order})
    ranked = global_rank(top, [F.asc("o"), *by_recency(), F.asc("trace_id")])
    return ranked.select("bucket", F.col("rank").cast("bigint").alias("rank"), "trace_id", updated().alias("updated_ms"))


def session_pages(sessions: DataFrame, first: int = 20, size: int = 40) -> DataFrame:
    """Page number of every session: the newest ``first`` are page 0, older ones follow in pages of ``size``."""
    r = global_rank(sessions, [*by_mtime(), F.asc("trace_id")])
    page = F.when(F.col("rank") <= first, 0).otherwise(F.floor((F.col("rank") - first - 1) / size) + 1)
    return r.withColumn("page", page.cast("bigint"))


def timeline(events: DataFrame, descending: bool = False) -> DataFrame:
    keys = [F.coalesce("ts_ms", F.lit(0)), F.col("index")]
    return events.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def event_page(events: DataFrame, limit: int = 400, before: int | None = None, include_meta: bool = True,
               order: str = "index") -> DataFrame:
    """Last ``limit`` events of every session before a cursor position, with both cursors.

    Without a cursor the page is a pruned top-k; with one the positions are counted chunk-wise. ``next_before`` is the
    cursor of the page before, 0 when there is none.
    """
    rows = events if include_meta else without_meta(events)
    limit = max(1, min(5000, limit))
    total = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("live_cursor"))
    if before is None:
        page = ranked(rows, ["trace_id"], [F.desc(order)], "__back", limit).drop("__back").join(total, "trace_id")
        return page.withColumn("next_before", F.greatest(F.col("live_cursor") - limit, F.lit(0)))
    cut = max(0, before)
    placed = running(rows, ["trace_id"], order, {"__place": ("count", None)}, 1_000_000)
    last = F.least(F.lit(cut), F.col("live_cursor"))
    total = total.withColumn("next_before", F.greatest(last - limit, F.lit(0)))
    # sessions shorter than the cursor end earlier, which only a comparison with their own length shows
    page = placed.filter(F.col("__place") <= cut).join(total, "trace_id")
    return page.filter(F.col("__place") > F.col("next_before")).drop("__place")


def session_detail(events: DataFrame, trace_id: str) -> DataFrame:
    return events.filter(F.col("trace_id") == trace_id)


def resolve_id(sessions: DataFrame, candidate: str) -> DataFrame:
    """Trace id itself, else the newest session with that session id; 'latest' is the most recent session."""
    if candidate.strip().lower() == "latest":
        return sessions.orderBy(*by_recency()).limit(1)
    own = F.when(F.col("trace_id") == candidate, 0).otherwise(1)
    hit = sessions.filter((F.col("trace_id") == candidate) | (F.col("session_id") == candidate))
    return hit.orderBy(own, *by_mtime()).limit(1)


def resolve_many(sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, trace_id) for a table of ids; unknown ids stay out."""
    exact = candidates.join(sessions.select("trace_id"), F.col("candidate") == F.col("trace_id")).select(
        "candidate", "trace_id", F.lit(0).alias("p"))
    newest = sessions.filter("session_id <> ''").groupBy("session_id").agg(
        F.min_by("trace_id", F.struct(-F.col("mtime_ms"), F.col("path"))).alias("trace_id"))
    named = candidates.join(newest, F.col("candidate") == F.col("session_id")).select("candidate", "trace_id", F.lit(1).alias("p"))
    return exact.unionByName(named).groupBy("candidate").agg(F.min_by("trace_id", "p").alias("trace_id"))


def badges(v: Column) -> Column:
    """Up to three distinct tags of a raw row: model, approval policy, hook, system subtype."""
    s = lambda p: F.when(V.is_string(V.sub(v, p)), V.text(v, p)).otherwise("")
    tag = lambda name, x: F.when(x != "", F.concat(F.lit(f"{name}:"), x)).otherwise("")
    typ = s("$.type")
    on = lambda t, x: F.when(typ == t, x).otherwise("")
    tags = F.array(tag("model", F.trim(s("$.model"))), on("turn_context", tag("model", s("$.payload.model"))),
                   on("turn_context", tag("approval", s("$.payload.approval_policy"))), on("progress", tag("hook", s("$.data.hookEvent"))),
                   on("system", tag("system", s("$.subtype"))))
    return F.slice(F.array_distinct(F.filter(tags, lambda t: t != "")), 1, 3)


def session_cwd(events: DataFrame) -> DataFrame:
    """Working directory named first by a session's metadata rows."""
    v = F.try_parse_json("raw_json")
    s = lambda p: F.when(V.is_string(V.sub(v, p)), X.strip(V.text(v, p))).otherwise("")
    cwd = V.first_filled(s("$.payload.cwd"), s("$.cwd"))
    rows = events.filter(F.col("raw_type").isin("session_meta", "session")).select("trace_id", "index", cwd.alias("cwd"))
    return rows.filter("cwd <> ''").groupBy("trace_id").agg(F.min_by("cwd", "index").alias("cwd"))
