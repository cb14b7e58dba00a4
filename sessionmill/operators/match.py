"""Which launch does a session belong to? (JN12-JN14, FI16)

``launches``: pid, user, args, cwd, tty, started_ms. Candidates are never paired with sessions inside a group: a session
meets its named launch by an equi join on the id found in the arguments, and a group's only launch by the group's count.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids
from .ordered import running

# What the command line of each agent looks like.
_COMMANDS = {"codex": r"\bcodex\b", "claude": r"\bclaude\b", "cursor": r"\bcursor\b", "gemini": r"\bgemini\b", "opencode": r"\bopencode\b"}
_PI = (r"^(?:\S*/)?pi(?:\s|$)|\bexec\s+(?:\S*/)?pi(?:\s|$)|\b(?:node|bun|deno)\b\s+\S*/pi(?:\s|$)|\bpi-coding-agent\b"
       r"|\b(?:node|bun|deno)\b\s+\S*pi-coding-agent")


def same_user(user: Column, name: str, uid: str) -> Column:
    u = F.trim(user)
    return F.lit(not name and not uid) | (u == "") | u.isin(name, uid)


def belongs_to(args: Column, agent: str) -> Column:
    """The command line runs the agent, and not as its background server."""
    cmd = F.lower(F.trim(args))
    ok = (cmd != "") & cmd.rlike(_PI if agent == "pi" else _COMMANDS.get(agent, r"$^"))
    return ok & ~(cmd.rlike(r"\bopencode\b") & cmd.rlike(r"\bserve\b")) if agent == "opencode" else ok


def agent_of(args: Column) -> Column:
    """Agents a command line belongs to."""
    names = [*_COMMANDS, "pi"]
    return F.filter(F.array(*[F.when(belongs_to(args, a), a) for a in names]), lambda a: a.isNotNull())


def project_key(agent: Column, path: Column, cwd: Column) -> Column:
    """Key of a session's project in the agent's own spelling: from its file's directory, or from its working directory
    for agents whose files do not tell."""
    return (F.when(agent == "cursor", ids.slug_project_of_path(path)).when(agent == "gemini", ids.hashed_project_of_path(path))
            .when(agent == "claude", ids.dashed_project_of_path(path)).otherwise(ids.dashed_project_of_cwd(cwd)))


def launch_project_keys(agent: Column, cwd: Column) -> Column:
    return (F.when(agent == "cursor", F.array(ids.slug_project_of_cwd(cwd))).when(agent == "gemini", ids.hashed_projects_of_cwd(cwd))
            .otherwise(F.array(ids.dashed_project_of_cwd(cwd))))


def _grouped(sessions: DataFrame, candidates: DataFrame, keep_ambiguous: bool) -> DataFrame:
    """``sessions``: trace_id, grp, sid; ``candidates``: grp, pid, sids (ids found in the arguments)."""
    named = candidates.select("grp", "pid", F.explode("sids").alias("sid")).distinct()
    hits = sessions.filter("sid <> ''").join(named, ["grp", "sid"]).select("trace_id", "pid", F.lit("session_id").alias("how"))
    size = candidates.groupBy("grp").agg(F.count_distinct("pid").alias("n"), F.min("pid").alias("pid"))
    open_ = sessions.join(hits.select("trace_id").distinct(), "trace_id", "left_anti").join(size, "grp")
    only = open_.filter("n = 1").select("trace_id", "pid", F.lit("only_candidate").alias("how"))
    out = hits.unionByName(only)
    if keep_ambiguous:
        # all candidates of the group are meant; they stay a group, whose members are one lookup away
        many = open_.filter("n > 1").select("trace_id", F.lit(None).cast("bigint").alias("pid"), F.lit("whole_group").alias("how"))
        out = out.unionByName(many)
    return out


def match_by_project(sessions: DataFrame, launches: DataFrame, id_pattern: str | None = None) -> DataFrame:
    """Launches in the session's project directory: those naming the session, else the only one there (JN12).

    ``sessions``: trace_id, user, agent, path, cwd, session_id.
    """
    s = sessions.withColumn("key", project_key(F.col("agent"), F.col("path"), F.col("cwd"))).filter("key <> ''").select(
        "trace_id", F.struct("user", "agent", "key").alias("grp"), F.lower(F.trim("session_id")).alias("sid"))
    lc = launches.withColumn("agent", F.explode(agent_of(F.col("args"))))
    lc = lc.withColumn("key", F.explode(launch_project_keys(F.col("agent"), F.col("cwd")))).filter("key <> ''")
    c = lc.select(F.struct("user", "agent", "key").alias("grp"), "pid", _ids_in(F.col("args"), id_pattern).alias("sids"))
    return _grouped(s, c, False)


def match_by_session_id(sessions: DataFrame, launches: DataFrame, id_pattern: str | None = None,
                        keep_ambiguous: bool = False) -> DataFrame:
    """Launches of the same user and agent that name the session, else the only one (JN13).

    With ``keep_ambiguous`` a session without a named launch keeps its whole group, as for processes that hold the
    session's file open; a lone launch of the user then also counts when none belongs to the agent.
    """
    s = sessions.select("trace_id", F.struct("user", "agent").alias("grp"), F.lower(F.trim("session_id")).alias("sid"), "user")
    c = launches.withColumn("agent", F.explode(agent_of(F.col("args")))).select(
        F.struct("user", "agent").alias("grp"), "pid", _ids_in(F.col("args"), id_pattern).alias("sids"))
    out = _grouped(s.drop("user"), c, keep_ambiguous)
    if keep_ambiguous:
        lone = launches.groupBy("user").agg(F.count_distinct("pid").alias("n"), F.min("pid").alias("pid")).filter("n = 1")
        rest = s.join(c.select("grp").distinct(), "grp", "left_anti").join(lone, "user").select(
            "trace_id", "pid", F.lit("only_of_user").alias("how"))
        out = out.unionByName(rest)
    return out


def _ids_in(args: Column, pattern: str | None) -> Column:
    """What may be a session id in the arguments: matches of the pattern, or without one every word, with and without its dots, and
    UUIDs inside longer words. Session ids then meet them by an equi join, whatever their form."""
    found = [pattern] if pattern else [r"[a-z0-9_-]+", r"[a-z0-9._-]+", ids.UUID]
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.lower(args), F.lit(f"({p})"), F.lit(1)) for p in found])))


def nearest_group(sessions: DataFrame, launches: DataFrame, chunk_ms: int = 86_400_000) -> DataFrame:
    """Terminal whose first launch is nearest in time to the session's start; a tie of the two best gives none (JN14).

    ``sessions``: trace_id, key, start_ms; ``launches``: key, tty, pid, started_ms. Both lie on one time line per key.
    The anchor before and the anchor after a session come from running values cut into day chunks, so neither a
    pairing of sessions with launches nor a whole key in one task is needed.
    """
    groups = launches.filter("tty <> '' AND started_ms > 0").groupBy("key", "tty").agg(F.min("started_ms").alias("anchor"))
    anchors = groups.groupBy("key", "anchor").agg(F.count(F.lit(1)).alias("ttys"), F.min("tty").alias("tty"))
    point = F.struct("anchor", "ttys", "tty")
    line = (anchors.select("key", F.col("anchor").alias("at"), F.lit(0).alias("is_session"), F.lit("").alias("trace_id"), point.alias("a"))
            .unionByName(sessions.filter("start_ms > 0").select("key", F.col("start_ms").alias("at"), F.lit(1).alias("is_session"), "trace_id",
                                                                F.lit(None).cast("struct<anchor:bigint,ttys:bigint,tty:string>").alias("a"))))
    back = running(line, ["key"], "at", {"before": ("last", F.col("a"))}, chunk_ms, tie=["is_session"])
    # the same in reversed time; an anchor at the session's own time already counts as before
    flipped = back.withColumn("neg", -F.col("at")).withColumn("after_rank", -F.col("is_session"))
    both = running(flipped, ["key"], "neg", {"after": ("last", F.col("a"))}, chunk_ms, tie=["after_rank"])
    d1, d2 = F.col("at") - F.col("before.anchor"), F.col("after.anchor") - F.col("at")
    s = both.filter("is_session = 1").withColumns({"d1": d1, "d2": d2})
    use_before = F.col("d2").isNull() | (F.col("d1") < F.col("d2"))
    best = F.when(F.col("d1").isNotNull() & use_before, F.col("before")).when(F.col("d1").isNull() | (F.col("d2") < F.col("d1")), F.col("after"))
    return s.withColumn("b", best).filter(F.col("b").isNotNull() & (F.col("b.ttys") == 1)).select(
        "trace_id", "key", F.col("b.tty").alias("tty"), F.abs(F.col("b.anchor") - F.col("at")).alias("distance_ms"))
