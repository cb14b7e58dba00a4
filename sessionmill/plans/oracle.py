"""DuckDB statements that say the same as the registered queries, written independently of the operators."""
from __future__ import annotations

from ..operators.pricing import rate_values
from ..params import RATE_COLUMNS
from ..schemas import AGENT_KINDS, EVENT_KINDS
from .datasets import MODELS, NOW_MS, WAIT_TEXT


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


EVENTS = f"""
ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, user_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms,
  {_list(AGENT_KINDS)}[user_id % 7 + 1] AS agent,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE 'sess-' || user_id END AS session_id,
  CASE event_type WHEN 'view' THEN 'assistant' WHEN 'click' THEN 'tool_use' WHEN 'purchase' THEN 'tool_result'
    WHEN 'error' THEN 'tool_result' WHEN 'signup' THEN 'user' ELSE 'meta' END AS event_kind,
  event_type AS raw_type, event_type = 'error' AS has_error, k,
  CASE WHEN event_type IN ('click', 'purchase', 'error') THEN CAST(k AS VARCHAR) ELSE '' END AS tool_use_id,
  CASE WHEN event_type = 'click' THEN 'tool_' || k % 9 ELSE '' END AS tool_name,
  CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'type_' || k % 4 ELSE '' END AS tool_type,
  user_id || ':' || event_id AS event_id,
  CASE WHEN event_type = 'view' AND k % 11 = 0 THEN '{WAIT_TEXT}' ELSE event_type || ' ' || k END AS preview,
  {_list(MODELS)}[user_id % 5 + 1] AS model,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, k * 10 AS cached_read_tokens,
  CAST(floor(value * 20) AS BIGINT) AS output_tokens,
  row_number() OVER (PARTITION BY user_id ORDER BY ev0.event_id) AS index FROM ev0)"""

SESS = f"""
sess AS (SELECT trace_id, any_value(agent) AS agent, any_value(session_id) AS session_id, count(*) AS event_count,
  count(*) FILTER (WHERE has_error) AS error_count,
  count(*) FILTER (WHERE event_kind = 'tool_use') AS tool_use_count,
  count(*) FILTER (WHERE event_kind = 'tool_result') AS tool_result_count,
  arg_min(ts_ms, seq) AS first_ts_ms, arg_max(ts_ms, seq) AS last_ts_ms, max(ts_ms) + 1000 AS mtime_ms,
  '/logs/' || any_value(agent) || '/' || trace_id || '.jsonl' AS path FROM ev GROUP BY trace_id)"""

SEG = """
seg1 AS (SELECT trace_id, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER w <= 1200000 THEN 0 ELSE 1 END AS fresh
  FROM ev WHERE ts_ms > 0 WINDOW w AS (PARTITION BY trace_id ORDER BY ts_ms)),
seg2 AS (SELECT trace_id, ts_ms, sum(fresh) OVER (PARTITION BY trace_id ORDER BY ts_ms) AS seg_no FROM seg1),
seg AS (SELECT trace_id, CAST(seg_no AS BIGINT) AS seg_no, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms,
  count(*) AS n_events FROM seg2 GROUP BY ALL)"""

NORMALISED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(model)),
  '^global\\.anthropic\\.', ''), '^anthropic/', ''), '^openai/', ''), '-v\\d+(?::\\d+)?$', ''),
  '^claude-(haiku|sonnet|opus)-4-(5|6)(?:-\\d{8})?$', 'claude-\\1-4.\\2'),
  '^(gpt-5\\.4|gpt-5\\.3-codex|gpt-5\\.2-codex|gpt-5\\.2)-\\d{4}-\\d{2}-\\d{2}$', '\\1')"""

RATES = f"rates AS (SELECT * FROM (VALUES {rate_values()}) t(ord, {', '.join(RATE_COLUMNS)}))"


def _tier(name: str) -> str:
    return f"CASE WHEN prompt_tokens > long_threshold THEN coalesce(long_{name}, {name}) ELSE {name} END"


def _part(tokens: str, name: str) -> str:
    return f"CAST(greatest({tokens}, 0) AS DECIMAL(18,0)) * CAST({_tier(name)} AS DECIMAL(12,6))"


COST = (f"CAST(round(({_part('input_tokens', 'input_rate')} + {_part('cached_read_tokens', 'cached_read_rate')} + "
        f"{_part('output_tokens', 'output_rate')}) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(18,6))")

PRICED = f"""{RATES},
us0 AS (SELECT *, input_tokens + cached_read_tokens AS prompt_tokens,
  input_tokens + cached_read_tokens + output_tokens AS total_tokens,
  CASE WHEN k % 3 = 0 THEN CAST(k / 1000.0 AS DECIMAL(18,6)) END AS embedded_cost, {NORMALISED} AS norm FROM ev),
us AS (SELECT us0.*, r.context_window_tokens, r.ord, {COST} AS cost_usd,
  prompt_tokens / coalesce(r.context_window_tokens, 200000) * 100 AS context_pct
  FROM us0 LEFT JOIN rates r ON r.model = us0.norm)"""

TURNS = f"""
tu AS (SELECT CAST(conv_id AS VARCHAR) AS trace_id, turn + 1 AS index, role, text,
  CASE WHEN role IN ('system', 'developer') THEN 'system' WHEN role = 'user' THEN 'user' ELSE 'assistant' END
    AS event_kind,
  CASE WHEN turn % 4 = 1 THEN {_list(MODELS)}[conv_id % 5 + 1] ELSE '' END AS event_model FROM conversations)"""


def q(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body if ctes else body


def windows(start_ms: int, days: int, window_ms: int, bin_ms: int) -> str:
    """Window, bin, activity, event and usage relations of a report whose windows all lie in the past."""
    nb = -(-window_ms // bin_ms)
    agents = ", ".join(f"count(*) FILTER (WHERE agent = '{a}') AS agent_{a}" for a in AGENT_KINDS)
    kinds = ", ".join(f"count(*) FILTER (WHERE event_kind = '{k}') AS kind_{k}" for k in EVENT_KINDS)
    zero = ", ".join([f"coalesce(agent_{a}, 0) AS agent_{a}" for a in AGENT_KINDS]
                     + [f"coalesce(kind_{k}, 0) AS kind_{k}" for k in EVENT_KINDS])
    return f"""
wins AS (SELECT CAST(d AS INTEGER) AS day, {start_ms} + d * 86400000 AS ws,
  {start_ms} + d * 86400000 + {window_ms} AS we,
  strftime(make_timestamp(({start_ms} + d * 86400000) * 1000), '%Y-%m-%d') AS date_local FROM range({days}) t(d)),
grid AS (SELECT day, date_local, CAST(b AS INTEGER) AS bin, ws + b * {bin_ms} AS start_ms,
  least(ws + (b + 1) * {bin_ms}, we) AS end_ms FROM wins, range({nb}) t(b)),
span AS (SELECT trace_id, agent, greatest(last_ts_ms, mtime_ms) AS upd, least(first_ts_ms, last_ts_ms) AS ss,
  greatest(first_ts_ms, last_ts_ms) AS se FROM sess),
pieces AS (SELECT day, s.trace_id, agent, upd, greatest(s.start_ms, ws) AS lo, least(s.end_ms, we - 1) AS hi, ws
  FROM seg s JOIN span USING (trace_id) JOIN wins ON s.end_ms >= ws AND s.start_ms < we AND se >= ws AND ss < we),
act AS (SELECT DISTINCT day, CAST(b AS INTEGER) AS bin, trace_id, agent, upd FROM pieces
  JOIN range({nb}) t(b) ON b BETWEEN (lo - ws) // {bin_ms} AND (hi - ws) // {bin_ms}),
actb AS (SELECT day, bin, count(*) AS active_sessions, {agents},
  arg_min(trace_id, (-upd, trace_id)) AS primary_trace_id FROM act GROUP BY day, bin),
evb AS (SELECT day, CAST((ts_ms - ws) // {bin_ms} AS INTEGER) AS bin, count(*) AS event_count, {kinds}
  FROM ev JOIN span USING (trace_id) JOIN wins ON ts_ms >= ws AND ts_ms < we AND se >= ws AND ss < we GROUP BY 1, 2),
usb AS (SELECT day, CAST((ts_ms - ws) // {bin_ms} AS INTEGER) AS bin, sum(output_tokens) AS output_tokens,
  sum(coalesce(cost_usd, 0)) AS total_cost_usd
  FROM us JOIN span USING (trace_id) JOIN wins ON ts_ms >= ws AND ts_ms < we AND se >= ws AND ss < we GROUP BY 1, 2),
bins AS (SELECT day, date_local, bin, start_ms, end_ms, coalesce(active_sessions, 0) AS active_sessions, {zero},
  coalesce(event_count, 0) AS event_count, coalesce(primary_trace_id, '') AS primary_trace_id,
  CAST(coalesce(output_tokens, 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(total_cost_usd, 0) AS DOUBLE) AS total_cost_usd
  FROM grid LEFT JOIN actb USING (day, bin) LEFT JOIN evb USING (day, bin) LEFT JOIN usb USING (day, bin))"""
