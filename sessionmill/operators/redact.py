"""Secret redaction of events (NO15)."""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..params import KEY_FALLBACK, VALUE_FALLBACK, RedactionParams


def compiled(pattern: str, fallback: str) -> str:
    """The pattern, or the fallback where it is empty or no regular expression."""
    p = pattern.strip()
    try:
        re.compile(p)
    except re.error:
        return fallback
    return p or fallback


def redact_text(c: Column, p: RedactionParams) -> Column:
    escaped = p.replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, compiled(p.value_pattern, VALUE_FALLBACK), escaped)


def _walk(x, key: re.Pattern, value: re.Pattern, mask: str):
    if isinstance(x, str):
        return value.sub(lambda _: mask, x)
    if isinstance(x, list):
        return [_walk(i, key, value, mask) for i in x]
    if isinstance(x, dict):
        return {k: mask if key.search(k) else _walk(i, key, value, mask) for k, i in x.items()}
    return x


def raw_redactor(p: RedactionParams):
    """Arrow-batched masking of nested JSON text; only rows that look suspicious are ever sent to it."""
    key, value, mask = compiled(p.key_pattern, KEY_FALLBACK), compiled(p.value_pattern, VALUE_FALLBACK), p.replacement

    @pandas_udf("string")
    def redact_raw(rows: pd.Series) -> pd.Series:
        k, v = re.compile(key), re.compile(value)
        return rows.map(lambda r: None if r is None else json.dumps(
            _walk(json.loads(r), k, v, mask), ensure_ascii=False, separators=(",", ":")))
    return redact_raw


def redact_events(events: DataFrame, p: RedactionParams = RedactionParams()) -> DataFrame:
    """Masks secrets in all texts and in the raw row; the search text is rebuilt from the masked fields."""
    if not p.active:
        return events
    r = lambda name: redact_text(F.col(name), p)
    suspicious = F.col("raw_json").rlike(compiled(p.value_pattern, VALUE_FALLBACK)) | F.col("raw_json").rlike(compiled(p.key_pattern, KEY_FALLBACK))
    masked = events.withColumns({
        "preview": r("preview"), "text_blocks": F.transform("text_blocks", lambda t: redact_text(t, p)),
        "tool_args_text": r("tool_args_text"), "tool_result_text": r("tool_result_text"), "toc_label": r("toc_label"),
        "__raw": raw_redactor(p)(F.when(suspicious, F.col("raw_json")))})
    search = F.lower(F.concat_ws("\n", "preview", "raw_type", F.array_join("text_blocks", "\n"), "tool_args_text", "tool_result_text"))
    return masked.withColumns({"raw_json": F.coalesce("__raw", "raw_json"), "search_text": search}).drop("__raw")
