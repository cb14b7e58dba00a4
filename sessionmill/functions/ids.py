"""Identifiers and keys (SF07, SF15, SF16, SF23, SF24)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as X

UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def stable_id(*parts: Column) -> Column:
    nul = F.lit("\u0000")
    return F.substring(F.sha1(F.concat(*[x for p in parts for x in (p, nul)])), 1, 24)


def session_id_plain(path: Column) -> Column:
    return X.basename_stem(path)


def session_id_document(path: Column) -> Column:
    return F.regexp_replace(X.basename_stem(path), "^session-", "")


def session_id_suffix(path: Column) -> Column:
    """Trailing UUID of the file name, else what follows the last underscore, else the whole name."""
    base = X.basename_stem(path)
    uuid = F.lower(F.regexp_extract(base, f"(?i)({UUID})$", 1))
    return F.when(uuid != "", uuid).when(base.rlike("_[^_]+$"), F.trim(F.substring_index(base, "_", -1))).otherwise(base)


def pricing_model(model: Column) -> Column:
    """Canonical model id for price and window look-ups."""
    m = F.lower(F.trim(model))
    for pattern in (r"^global\.anthropic\.", "^anthropic/", "^openai/", r"-v\d+(?::\d+)?$"):
        m = F.regexp_replace(m, pattern, "")
    tail = F.trim(F.substring_index(m, "/", -1))
    m = F.when(m.contains("/") & tail.rlike("^(claude-|gpt-)"), tail).otherwise(m)
    m = F.regexp_replace(m, r"^claude-(haiku|sonnet|opus)-4-(5|6)(?:-\d{8})?$", "claude-$1-4.$2")
    return F.regexp_replace(m, r"^(gpt-5\.4|gpt-5\.3-codex|gpt-5\.2-codex|gpt-5\.2)-\d{4}-\d{2}-\d{2}$", "$1")


def _slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def _slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def dashed_project_of_path(path: Column) -> Column:
    return F.regexp_extract(_slashes(path), r"/\.claude/projects/([^/]+)/", 1)


def dashed_project_of_cwd(cwd: Column) -> Column:
    n = _slashes(F.trim(cwd))
    absolute = F.when(n.startswith("/"), n).otherwise(F.concat(F.lit("/"), n))
    return F.when(n == "", F.lit("")).otherwise(F.regexp_replace(absolute, "[^A-Za-z0-9]+", "-"))


def slug_project_of_path(path: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(_slashes(path), r"/\.cursor/projects/([^/]*)", 1)))


def slug_project_of_cwd(cwd: Column) -> Column:
    return _slug(F.regexp_replace(_slashes(F.trim(cwd)), "^/+", ""))


def hashed_project_of_path(path: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(_slashes(path), r"/\.gemini/tmp/([^/]*)", 1)))


def hashed_projects_of_cwd(cwd: Column) -> Column:
    """All keys a working directory may have: SHA-256 of its spellings, slug of its last part and of the whole."""
    t = F.trim(cwd)
    n = F.regexp_replace(_slashes(t), "/+$", "")
    last = F.regexp_extract(n, r"([^/]+)$", 1)
    keys = F.array(F.when(t != "", F.sha2(t, 256)), F.when(F.trim(n) != "", F.sha2(F.trim(n), 256)),
                   _slug(last), _slug(n))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def session_ids_in_paths(paths: Column) -> Column:
    pattern = rf"(?i)/\.cursor/chats/[^/]+/({UUID})/store\.db(?:-wal|-shm)?$"
    ids = F.transform(paths, lambda p: F.lower(F.regexp_extract(_slashes(p), pattern, 1)))
    return F.array_distinct(F.filter(ids, lambda i: i != ""))


def session_ids_in_log(log: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(log, F.lit("sessionID=(ses_[A-Za-z0-9]+)"), F.lit(1)))


def debug_log_pid(line: Column) -> Column:
    """Process id named by one debug log line, null if the line names none."""
    tmp = F.regexp_extract(line, r"\.claude\.json\.tmp\.(\d+)\.", 1)
    lock = F.when(line.contains("Acquired PID lock"), F.regexp_extract(line, r"\(PID\s+(\d+)\)", 1))
    pid = F.when(tmp != "", tmp).otherwise(lock).try_cast("bigint")
    return F.when(pid > 0, pid)


def log_mentions_session(log: Column, session_id: Column) -> Column:
    """A JSON array log must hold an entry with exactly this id; any other log text must contain it."""
    sid = F.lower(F.trim(session_id))
    parsed = F.try_parse_json(log)
    entries = F.try_variant_get(parsed, "$", "array<variant>")
    exact = F.exists(entries, lambda e: F.lower(F.trim(F.try_variant_get(e, "$.sessionId", "string"))) == sid)
    return (sid != "") & F.when(entries.isNotNull(), F.coalesce(exact, F.lit(False))).otherwise(
        F.contains(F.lower(log), sid))
