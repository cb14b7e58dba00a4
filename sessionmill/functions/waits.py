"""Does an event ask the user for something? (SF18, SF19)"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import variants as V

# Text patterns and raw fields that signal a wait.
WAIT_TEXT = (r"(?i)\b(?:await(?:ing)?\s+(?:user|input)|waiting\s+for\s+(?:user|input|approval)|user\s+input\s+required"
             r"|needs?\s+user\s+input|permission\s+required|approval\s+required|confirm(?:ation)?\s+(?:required|needed)"
             r"|press\s+enter\s+to\s+continue)\b")
PROMPT_TEXT = (r"(?i)\b(?:do\s+you\s+want(?:\s+me)?|would\s+you\s+like(?:\s+me)?|should\s+i\b|can\s+you\s+confirm"
               r"|please\s+confirm|let\s+me\s+know\s+if\s+you(?:'d)?\s+like|which\s+(?:option|approach)"
               r"|choose\s+(?:one|an?\s+option)|pick\s+(?:one|an?\s+option)|approve(?:\s+this)?|permission\s+to)\b")
WAIT_FIELDS = tuple(
    [f"$.{f}" for f in ("type", "subtype", "status", "state", "phase", "reason")]
    + [f"$.payload.{f}" for f in ("type", "subtype", "status", "state", "phase", "reason")]
    + [f"$.part.{f}" for f in ("type", "status", "state", "phase", "reason")]
    + [f"$.part.state.{f}" for f in ("status", "state", "phase", "reason")]
    + [f"$.message.{f}" for f in ("status", "state", "phase")]
)


def marker_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[_-]+", " ")


def is_wait_marker(c: Column) -> Column:
    def test(m: Column) -> Column:
        who = m.contains("user") | m.contains("input")
        return ((m == "waiting")
                | (m.contains("awaiting") & who)
                | (m.contains("waiting for") & who)
                | ((m.contains("needs") | m.contains("requires")) & m.contains("input"))
                | m.rlike("(approval|permission) required|confirmation (required|needed)|press enter to continue"))
    return V.let(marker_text(c), test)


# every marker has one of these words; an escaped letter may hide one
_MARKER_WORDS = r"(?i)wait|need|requir|press|\\u00"


def structured_wait_text(raw_json: Column, raw_type: Column) -> Column:
    """``structured_wait`` of a row's JSON text, which is parsed only where a marker's word occurs at all."""
    maybe = F.concat_ws(" ", raw_type, raw_json).rlike(_MARKER_WORDS)
    parsed = F.when(maybe, F.try_parse_json(raw_json))
    return F.when(maybe, structured_wait(parsed, raw_type)).otherwise(F.lit(False))


def structured_wait(v: Column, raw_type: Column) -> Column:
    """A row's type or one of its fields is a marker. The row is evaluated once, not for every field, and fields that are not there are passed over."""
    def test(x: Column) -> Column:
        values = F.array(x["t"], *[F.try_variant_get(x["v"], p, "string") for p in WAIT_FIELDS])
        return F.exists(values, lambda m: m.isNotNull() & F.coalesce(is_wait_marker(m), F.lit(False)))
    return V.let(F.struct(v.alias("v"), raw_type.alias("t")), test)


def text_wait(*parts: Column) -> Column:
    joined = F.concat_ws(" ", *parts)
    return joined.rlike(WAIT_TEXT) | joined.rlike(PROMPT_TEXT)


def is_resolution(kind: Column) -> Column:
    return kind.isin("user", "tool_use", "tool_result")
