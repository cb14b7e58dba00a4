"""Which format is a file, and how is it read? (SC11, UX01, UX02)"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import claude, codex, cursor, gemini, generic, pi

HEAD_CHARS = 8192


@dataclass(frozen=True)
class Format:
    """``detect``: (lower path, lower head) -> confidence 0-1; ``normalize``: rows or lines -> events.

    ``reads``: ``rows`` (JSON lines), ``lines`` (plain lines), ``documents`` or ``entities``.
    """
    name: str
    agent: str
    detect: Callable[[Column, Column], Column]
    normalize: Callable[..., DataFrame] | None
    reads: str = "rows"


def _score(*parts: tuple[float, Column]) -> Column:
    total = F.lit(0).cast("decimal(4,2)")
    for weight, cond in parts:
        total = (total + F.when(cond, F.lit(str(weight)).cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)"))).cast("decimal(4,2)")
    return F.least(total, F.lit("1").cast("decimal(4,2)"))


def _has(head: Column, *needles: str) -> Column:
    cond = head.contains(needles[0])
    for n in needles[1:]:
        cond = cond | head.contains(n)
    return cond


def _typed(head: Column, name: str) -> Column:
    return _has(head, f'"type":"{name}"', f'"type": "{name}"')


def _all(head: Column, *needles: str) -> Column:
    cond = head.contains(needles[0])
    for n in needles[1:]:
        cond = cond & head.contains(n)
    return cond


# Confidence weights per format.
def _codex(p, h):
    return _score((0.4, p.contains("/.codex/")), (0.2, p.contains("/sessions/")), (0.1, p.endswith(".jsonl")),
                  (0.2, _typed(h, "response_item")), (0.2, _typed(h, "session_meta")),
                  (0.1, _has(h, '"type":"item.started"', '"type":"item.completed"')))


def _claude(p, h):
    return _score((0.3, p.contains("/.claude/")), (0.2, p.contains("/projects/")), (0.15, p.endswith("history.jsonl")),
                  (0.2, h.contains('"sessionid"')), (0.2, _typed(h, "assistant")),
                  (0.1, _has(h, '"parentuuid"', '"tool_use_result"')))


def _cursor(p, h):
    return _score((0.35, p.contains("/.cursor/")), (0.35, p.contains("/agent-transcripts/")), (0.1, p.endswith(".txt")),
                  (0.1, p.endswith(".jsonl")), (0.1, _all(h, '"role"', '"message"')),
                  (0.1, h.contains("\nuser:") | h.startswith("user:")),
                  (0.1, h.contains("\nassistant:") | h.startswith("assistant:")), (0.1, _has(h, "[tool call]", "[thinking]")))


def _opencode(p, h):
    return _score((0.2, p.contains("/opencode/")), (0.55, p.contains("/storage/session/")), (0.1, p.endswith(".json")),
                  (0.25, _all(h, '"slug"', '"projectid"', '"directory"')))


def _gemini(p, h):
    return _score((0.45, p.contains("/.gemini/")), (0.1, p.contains("/tmp/")), (0.15, p.contains("/chats/")),
                  (0.2, p.rlike(r"/session-[^/]+\.json$")), (0.05, p.endswith(".jsonl")),
                  (0.15, _all(h, '"projecthash"', '"messages"')),
                  (0.15, _has(h, '"type":"gemini"', '"toolcalls"', '"sessionid"')))


def _pi(p, h):
    return _score((0.35, p.contains("/.pi/")), (0.35, p.contains("/agent/sessions/")), (0.05, p.endswith(".jsonl")),
                  (0.1, _typed(h, "session")), (0.1, _typed(h, "message")),
                  (0.05, _has(h, '"type":"thinking_level_change"', '"type":"model_change"')),
                  (0.1, _has(h, '"type":"toolcall"', '"role":"toolresult"')))


DEFAULT_FORMATS = (
    Format("codex", "codex", _codex, codex.normalize), Format("claude", "claude", _claude, claude.normalize),
    Format("cursor", "cursor", _cursor, cursor.normalize, "lines"), Format("opencode", "opencode", _opencode, None, "entities"),
    Format("gemini", "gemini", _gemini, gemini.normalize, "documents"), Format("pi", "pi", _pi, pi.normalize),
    Format("generic", "unknown", lambda p, h: F.lit("0.01").cast("decimal(4,2)"), generic.normalize))


class FormatRegistry:
    """Ordered set of formats; earlier ones win ties."""

    def __init__(self, formats: tuple[Format, ...] = DEFAULT_FORMATS):
        self.formats = tuple(formats)

    def register(self, fmt: Format) -> "FormatRegistry":
        """A registry with the format added in front of the catch-all, replacing one of the same name."""
        if any(f.name == fmt.name for f in self.formats):
            return FormatRegistry(tuple(fmt if f.name == fmt.name else f for f in self.formats))
        return FormatRegistry((*self.formats[:-1], fmt, self.formats[-1]))

    def scores(self, path: Column, head: Column) -> dict[str, Column]:
        p, h = F.lower(path), F.lower(F.substring(head, 1, HEAD_CHARS))
        return {f.name: f.detect(p, h) for f in self.formats}

    def choose(self, path: Column, head: Column, hint: Column | None = None) -> Column:
        """Name of the format: the hint if it names one, else the best score."""
        best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("name"))
                                     for i, (n, s) in enumerate(self.scores(path, head).items())]))["name"]
        if hint is None:
            return best
        return F.when(hint.isin(*[f.name for f in self.formats]), hint).otherwise(best)
