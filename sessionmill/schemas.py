"""Column layouts and ordered key constants."""
from pyspark.sql import types as T

# Agent and event kinds. The order is part of the contract, it breaks ties.
AGENT_KINDS = ("claude", "codex", "cursor", "opencode", "gemini", "pi", "unknown")
AGENT_KINDS_DISPLAY = ("codex", "claude", "cursor", "opencode", "gemini", "pi", "unknown")
EVENT_KINDS = ("system", "assistant", "user", "tool_use", "tool_result", "reasoning", "compaction", "meta")
STATUSES = ("running", "waiting_input", "idle")
HEATMAP_METRICS = ("sessions", "output_tokens", "total_cost_usd")

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

RAW_ROWS = ("trace_id", "path", "row_no", "offset", "raw_json", "mtime_ms")

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("index", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("event_kind", T.StringType()),
    T.StructField("raw_type", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("preview", T.StringType()),
    T.StructField("text_blocks", T.ArrayType(T.StringType())),
    T.StructField("tool_use_id", T.StringType()),
    T.StructField("parent_tool_use_id", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("tool_type", T.StringType()),
    T.StructField("tool_call_id", T.StringType()),
    T.StructField("function_name", T.StringType()),
    T.StructField("tool_args_text", T.StringType()),
    T.StructField("tool_result_text", T.StringType()),
    T.StructField("parent_event_id", T.StringType()),
    T.StructField("toc_label", T.StringType()),
    T.StructField("has_error", T.BooleanType()),
    T.StructField("search_text", T.StringType()),
    T.StructField("raw_json", T.StringType()),
])
EVENT_COLUMNS = tuple(f.name for f in EVENT_SCHEMA)

TOKEN_COLUMNS = (
    "input_tokens", "cached_read_tokens", "cached_create_tokens",
    "output_tokens", "reasoning_output_tokens", "total_tokens",
)
