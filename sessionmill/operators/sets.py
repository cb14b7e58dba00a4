"""Unions, upserts, tiers and change sets (ST01-ST04, SS03, SS10, SS11, SS14, WF13)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..params import RetentionParams
from .browse import by_mtime
from .ordered import ranked

LATEST_EVENTS = 40


def union_first(parts: list[DataFrame], key: str = "event_id") -> DataFrame:
    """Union in which the first part that has a key wins."""
    return _union(parts, key, last=False)


def upsert_last(parts: list[DataFrame], key: str = "event_id") -> DataFrame:
    """Union in which the last part that has a key wins."""
    return _union(parts, key, last=True)


def _union(parts: list[DataFrame], key: str, last: bool) -> DataFrame:
    cols = parts[0].columns
    tagged = [p.select(*cols, F.lit(i).alias("__part")) for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    rest = [c for c in cols if c != key]
    pick = F.max_by if last else F.min_by
    one = both.groupBy(key).agg(pick(F.struct(*rest), "__part").alias("r"))
    return one.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*cols)


def change_actions(before: DataFrame, now: DataFrame) -> DataFrame:
    """What happened to each file between two listings (SS03): new, grown, rewritten, vanished or same."""
    b, n = before.alias("b"), now.alias("n")
    action = (F.when(F.col("b.trace_id").isNull(), "new").when(F.col("n.trace_id").isNull(), "vanished")
              .when(F.col("n.size_bytes") > F.col("b.size_bytes"), "grown")
              .when((F.col("n.size_bytes") == F.col("b.size_bytes")) & (F.col("n.mtime_ms") == F.col("b.mtime_ms")), "same")
              .otherwise("rewritten"))
    return b.join(n, F.col("b.trace_id") == F.col("n.trace_id"), "full").select(
        F.coalesce("n.trace_id", "b.trace_id").alias("trace_id"), action.alias("action"))


def retention_tiers(sessions: DataFrame, p: RetentionParams = RetentionParams()) -> DataFrame:
    """Tier of every session by recency. Only the hot and warm ones are ranked, which is a bounded top-k."""
    if p.strategy == "full_memory":
        return sessions.withColumn("tier", F.lit("hot"))
    kept = top_tiers(sessions, p)
    # the kept side has at most hot + warm rows
    return sessions.join(F.broadcast(kept), "trace_id", "left").fillna("cold", ["tier"])


def top_tiers(sessions: DataFrame, p: RetentionParams) -> DataFrame:
    top = sessions.orderBy(*by_mtime(), "trace_id").limit(p.hot_count + p.warm_count)
    place = F.row_number().over(W.orderBy(*by_mtime(), "trace_id"))
    return top.select("trace_id", F.when(place <= p.hot_count, "hot").otherwise("warm").alias("tier"))


def retained_events(events: DataFrame, sessions: DataFrame, p: RetentionParams = RetentionParams()) -> DataFrame:
    """Last events of the hot and warm sessions up to their tier's number; cold sessions keep none."""
    if p.strategy == "full_memory":
        return events
    kept = F.broadcast(top_tiers(sessions, p))
    tail = ranked(events.join(kept, "trace_id"), ["trace_id"], [F.desc("index")], "back", max(p.hot_events, p.warm_events))
    limit = F.when(F.col("tier") == "hot", p.hot_events).otherwise(p.warm_events)
    return tail.filter(F.col("back") <= F.greatest(limit, F.lit(1)))


def stamp(columns: list[str]) -> Column:
    """Fingerprint of a summary: changes when any of the columns does."""
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])


def coalesced_deltas(deltas: DataFrame) -> DataFrame:
    """One change per session and class of a batch (SS11).

    ``deltas``: version, type, trace_id ('' for the overview), appended, payload. A session added in the batch stays
    added unless a removal came after; the newest payload counts; appended numbers add up. ``first_version`` gives the
    first-seen order. Everything folds map-side, a hot session is no problem. With a column ``latest`` (event ids) the newest events
    of all appends of a session follow one another, each once where it came first; those are at most ``LATEST_EVENTS`` per append.
    """
    cls = (F.when(F.col("type").isin("trace_added", "trace_updated", "trace_removed"), "trace")
           .when(F.col("type") == "events_appended", "append").when(F.col("type") == "overview_updated", "overview"))
    at = lambda t: F.max(F.when(F.col("type") == t, F.col("version")))
    key = F.when(F.col("type") == "overview_updated", "").otherwise(F.col("trace_id"))
    merged = "latest" in deltas.columns
    parts = F.sort_array(F.collect_list(F.when((F.col("cls") == "append") & (F.size("latest") > 0), F.struct("version", "latest")))) if merged else None
    latest = [F.array_distinct(F.flatten(F.transform(parts, lambda x: x["latest"]))).alias("latest")] if merged else []
    per = (deltas.withColumn("cls", cls).filter("cls IS NOT NULL").withColumn("k", key).groupBy("k", "cls")
           .agg(F.min("version").alias("first_version"), F.max("version").alias("version"), F.max_by("type", "version").alias("last_type"),
                F.max_by("payload", "version").alias("payload"), F.sum("appended").alias("appended"),
                at("trace_added").alias("added_at"), at("trace_removed").alias("removed_at"), *latest))
    added = F.coalesce(F.col("added_at") > F.coalesce("removed_at", F.lit(-1)), F.lit(False))
    typ = F.when((F.col("cls") == "trace") & (F.col("last_type") != "trace_removed"),
                 F.when(added, "trace_added").otherwise("trace_updated")).otherwise(F.col("last_type"))
    return per.select(F.col("k").alias("trace_id"), typ.alias("type"), "version", "first_version",
                      F.when(F.col("cls") == "append", F.col("appended")).alias("appended"), "payload", *(["latest"] if merged else []))


def session_deltas(before: DataFrame, now: DataFrame, stamp_column: str = "stamp") -> DataFrame:
    """(trace_id, type) of sessions that are new, changed or gone between two stamped session tables."""
    b, n = before.alias("b"), now.alias("n")
    typ = (F.when(F.col("b.trace_id").isNull(), "trace_added").when(F.col("n.trace_id").isNull(), "trace_removed")
           .when(F.col(f"b.{stamp_column}") != F.col(f"n.{stamp_column}"), "trace_updated"))
    return b.join(n, F.col("b.trace_id") == F.col("n.trace_id"), "full").select(
        F.coalesce("n.trace_id", "b.trace_id").alias("trace_id"), typ.alias("type")).filter("type IS NOT NULL")
