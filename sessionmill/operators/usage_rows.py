"""Usage rows of every log format and what a session makes of them (AG08-AG19, WF02, WF03, FI14).

All formats end in one layout, ``USAGE_ROW_COLUMNS``. Token sums are whole numbers, money is DECIMAL.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions import variants as V
from ..params import CostParams
from ..schemas import TOKEN_COLUMNS
from . import pricing
from .ordered import ranked, running

USAGE_ROW_COLUMNS = ("trace_id", "agent", "row_no", "ts_ms", "model", *TOKEN_COLUMNS, "create_5m", "create_1h",
                     "prompt_tokens", "billable_input", "window_hint", "priced", "embedded_cost", "model_delta")


def finalised(total: Column, *parts: Column) -> Column:
    """A given total if positive, else the sum of the counters (AG14)."""
    s = parts[0]
    for p in parts[1:]:
        s = s + p
    return F.when(total > 0, total).otherwise(s)


def finalise_totals(df: DataFrame) -> DataFrame:
    return df.withColumn("total_tokens", finalised(*[F.col(c) for c in ("total_tokens", *TOKEN_COLUMNS[:5])]))


def positive(c: Column) -> Column:
    """Null, NaN, infinite and non-positive values become 0 (FI14)."""
    finite = ~F.isnan(c.cast("double")) & (c.cast("double") < float("inf"))
    return F.when(finite & (c > 0), c).otherwise(F.lit(0).cast("bigint"))


def _layout(df: DataFrame, agent: str, tokens: dict[str, Column], **extra: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    cols = {c: tokens.get(c, zero) for c in TOKEN_COLUMNS}
    total = cols.pop("total_tokens")
    base = df.withColumns({**cols, "create_5m": extra.pop("create_5m", zero), "create_1h": extra.pop("create_1h", zero)})
    base = base.withColumn("total_tokens", finalised(total, *[F.col(c) for c in TOKEN_COLUMNS[:5]]))
    prompt = extra.pop("prompt_tokens", F.col("input_tokens") + F.col("cached_read_tokens") + F.col("cached_create_tokens"))
    return base.withColumns({
        "agent": F.lit(agent),
        "prompt_tokens": prompt,
        "billable_input": extra.pop("billable_input", F.col("input_tokens")),
        "window_hint": extra.pop("window_hint", F.lit(None).cast("bigint")),
        "priced": extra.pop("priced", F.lit(True)),
        "embedded_cost": extra.pop("embedded_cost", F.lit(None).cast("decimal(18,6)")),
        "model_delta": extra.pop("model_delta", F.col("total_tokens")),
    }).select(*USAGE_ROW_COLUMNS)


def first_per_key(rows: DataFrame, key: str, order: str = "row_no") -> DataFrame:
    """First row per (trace, key); rows with an empty key all stay. Folds map-side, no window over a hot key."""
    cols = [c for c in rows.columns if c not in ("trace_id", key)]
    keyed = rows.filter(F.col(key) != "").groupBy("trace_id", key).agg(F.min_by(F.struct(*cols), order).alias("r"))
    keyed = keyed.select("trace_id", key, *[F.col(f"r.{c}").alias(c) for c in cols])
    return keyed.unionByName(rows.filter(F.col(key) == ""))


def claude_usage(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    req, msg = F.trim(V.text(v, "$.requestId")), F.trim(V.text(v, "$.message.id"))
    key = F.when(req != "", F.concat(F.lit("request:"), req)).when(msg != "", F.concat(F.lit("message:"), msg)) \
        .otherwise(F.lit(""))
    n = lambda p: V.long_number(v, f"$.message.usage.{p}")
    m5, h1 = n("cache_creation.ephemeral_5m_input_tokens"), n("cache_creation.ephemeral_1h_input_tokens")
    flat = rows.filter((F.lower(V.text(v, "$.type")) == "assistant") & V.has_keys(v, "$.message.usage")).select(
        "trace_id", "row_no", "ts_ms", key.alias("k"),
        V.first_filled(V.text(v, "$.message.model"), F.lit("<unknown>")).alias("model"),
        n("input_tokens").alias("i"), n("cache_read_input_tokens").alias("r"),
        n("cache_creation_input_tokens").alias("c"), m5.alias("m5"), h1.alias("h1"),
        n("output_tokens").alias("o"), n("reasoning_output_tokens").alias("ro"), n("total_tokens").alias("t"))
    one = first_per_key(flat, "k")
    return _layout(one, "claude", {
        "input_tokens": F.col("i"), "cached_read_tokens": F.col("r"),
        "cached_create_tokens": F.greatest(F.col("c"), F.col("m5") + F.col("h1")),
        "output_tokens": F.col("o"), "reasoning_output_tokens": F.col("ro"), "total_tokens": F.col("t"),
    }, create_5m=F.col("m5"), create_1h=F.col("h1"))


def codex_usage(rows: DataFrame) -> DataFrame:
    """Rows of cumulative snapshots; the model is the latest one named before the row."""
    v = F.col("v")
    typ, ptyp = F.lower(V.text(v, "$.type")), F.lower(V.text(v, "$.payload.type"))
    model = F.when(typ == "turn_context", F.nullif(V.text(v, "$.payload.model"), F.lit("")))
    is_count = (typ == "event_msg") & (ptyp == "token_count")
    n = lambda group, p: V.long_number(v, f"$.payload.info.{group}.{p}")

    def usage(group: str) -> Column:
        return F.struct(n(group, "input_tokens").alias("i"), n(group, "cached_input_tokens").alias("r"),
                        n(group, "output_tokens").alias("o"), n(group, "reasoning_output_tokens").alias("ro"),
                        n(group, "total_tokens").alias("t"))

    slim = rows.filter((typ == "turn_context") | is_count).select(
        "trace_id", "row_no", "ts_ms", is_count.alias("is_count"), model.alias("m"),
        usage("total_token_usage").alias("tot"),
        F.when(V.has_keys(v, "$.payload.info.last_token_usage"), usage("last_token_usage")).alias("last"),
        V.long_number(v, "$.payload.info.model_context_window").alias("win"))
    fin = finalised(F.col("tot.t"), F.col("tot.i"), F.col("tot.r"), F.col("tot.o"), F.col("tot.ro"))
    slim = slim.withColumn("cum", F.when(F.col("is_count"), fin))
    carried = running(slim, ["trace_id"], "row_no", {"cur_model": ("last", F.col("m")),
                                                     "prev": ("last_before", F.col("cum"))})
    rows = carried.filter("is_count").withColumn("u", F.coalesce("last", "tot"))
    u = lambda c: F.col(f"u.{c}")
    incl = (u("r") > 0) & (u("t") > 0) & (u("i") + u("r") + u("o") + u("ro") > u("t"))
    prompt = F.when(incl, u("i")).otherwise(u("i") + u("r"))
    named = F.col("cur_model").isNotNull()
    return _layout(
        rows.withColumn("model", F.coalesce("cur_model", F.lit("<unknown>"))), "codex",
        {"input_tokens": u("i"), "cached_read_tokens": u("r"), "output_tokens": u("o"),
         "reasoning_output_tokens": u("ro"), "total_tokens": u("t")},
        prompt_tokens=F.when(prompt > 0, prompt).otherwise(u("t")),
        billable_input=F.when(incl, F.greatest(u("i") - u("r"), F.lit(0).cast("bigint"))).otherwise(u("i")),
        window_hint=F.when(F.col("win") > 0, F.col("win")), priced=named,
        model_delta=F.greatest(F.col("cum") - F.coalesce(F.col("prev"), F.lit(0)), F.lit(0).cast("bigint")))


def codex_totals(rows: DataFrame) -> DataFrame:
    """Session totals are the last snapshot, not a sum."""
    v = F.col("v")
    n = lambda p: V.long_number(v, f"$.payload.info.total_token_usage.{p}")
    hit = rows.filter((F.lower(V.text(v, "$.type")) == "event_msg")
                      & (F.lower(V.text(v, "$.payload.type")) == "token_count"))
    snap = F.struct(n("input_tokens").alias("input_tokens"), n("cached_input_tokens").alias("cached_read_tokens"),
                    F.lit(0).cast("bigint").alias("cached_create_tokens"), n("output_tokens").alias("output_tokens"),
                    n("reasoning_output_tokens").alias("reasoning_output_tokens"),
                    n("total_tokens").alias("total_tokens"))
    last = hit.groupBy("trace_id").agg(F.max_by(snap, "row_no").alias("s"))
    return finalise_totals(last.select("trace_id", "s.*"))


def opencode_usage(rows: DataFrame) -> DataFrame:
    """Assistant messages; an id counts as seen even where its first row carries no tokens."""
    m = F.when(V.has_keys(F.col("v"), "$.message"), V.sub(F.col("v"), "$.message")).otherwise(F.col("v"))
    base = rows.withColumn("m", m).filter(F.lower(V.text(F.col("m"), "$.role")) == "assistant")
    m = F.col("m")
    n = lambda p: V.long_number(m, f"$.tokens.{p}")
    model = V.first_filled(V.text(m, "$.modelID"), V.text(m, "$.model.modelID"))
    provider = V.first_filled(V.text(m, "$.providerID"), V.text(m, "$.model.providerID"))
    flat = base.select(
        "trace_id", "row_no", "ts_ms", V.text(m, "$.id").alias("k"), V.has_keys(m, "$.tokens").alias("has"),
        F.when(model != "", model).when(provider != "", F.concat(provider, F.lit("/<unknown>")))
        .otherwise(F.lit("<unknown>")).alias("model"),
        n("input").alias("i"), n("cache.read").alias("r"), n("cache.write").alias("w"), n("output").alias("o"),
        n("reasoning").alias("ro"), n("total").alias("t"))
    return _layout(first_per_key(flat, "k").filter("has"), "opencode", {
        "input_tokens": F.col("i"), "cached_read_tokens": F.col("r"), "cached_create_tokens": F.col("w"),
        "output_tokens": F.col("o"), "reasoning_output_tokens": F.col("ro"), "total_tokens": F.col("t")})


def gemini_usage(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    n = lambda p: V.long_number(v, f"$.tokens.{p}")
    flat = rows.filter(F.lower(V.text(v, "$.type")).isin("gemini", "assistant", "model")).select(
        "trace_id", "row_no", "ts_ms", V.text(v, "$.id").alias("k"), V.has_keys(v, "$.tokens").alias("has"),
        V.first_filled(V.first_text(v, "$.model", "$.modelVersion"), F.lit("<unknown>")).alias("model"),
        n("input").alias("i"), n("cached").alias("r"), (n("output") + n("tool")).alias("o"),
        n("thoughts").alias("ro"), n("total").alias("t"))
    return _layout(first_per_key(flat, "k").filter("has"), "gemini", {
        "input_tokens": F.col("i"), "cached_read_tokens": F.col("r"), "output_tokens": F.col("o"),
        "reasoning_output_tokens": F.col("ro"), "total_tokens": F.col("t")})


def pi_usage(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    n = lambda p: V.long_number(v, f"$.message.usage.{p}")
    cost = F.try_variant_get(v, "$.message.usage.cost.total", "decimal(18,6)")
    hit = rows.filter((F.lower(V.text(v, "$.type")) == "message")
                      & (F.lower(V.text(v, "$.message.role")) == "assistant") & V.has_keys(v, "$.message.usage"))
    model = V.first_filled(V.first_text(v, "$.message.model", "$.message.modelId"), F.lit("<unknown>"))
    return _layout(hit.withColumn("model", model), "pi", {
        "input_tokens": n("input"), "cached_read_tokens": n("cacheRead"), "cached_create_tokens": n("cacheWrite"),
        "output_tokens": n("output"), "reasoning_output_tokens": n("reasoning"), "total_tokens": n("totalTokens"),
    }, embedded_cost=cost)


def estimated_usage(events: DataFrame) -> DataFrame:
    """Usage of transcripts without counters: estimated from the text of each event (AG13).

    Needs ``index``, ``event_kind``, ``text_blocks`` and ``event_model`` (empty when the event names none).
    """
    named = F.nullif(F.trim(F.col("event_model")), F.lit(""))
    carried = running(events.select("trace_id", "index", "ts_ms", "event_kind", named.alias("named"),
                                    X.token_estimate_blocks(F.col("text_blocks")).alias("n")),
                      ["trace_id"], "index", {"cur": ("last", F.col("named"))})
    first = carried.groupBy("trace_id").agg(F.min_by("named", F.when(F.col("named").isNotNull(), F.col("index")))
                                            .alias("first_model"))
    # rows before the first named model take that model: one row per trace on the small side
    head = carried.filter("cur IS NULL").drop("cur").join(first, "trace_id", "left") \
        .withColumnRenamed("first_model", "cur")
    rows = carried.filter("cur IS NOT NULL").unionByName(head)
    kind, n, zero = F.col("event_kind"), F.col("n"), F.lit(0).cast("bigint")
    prompt_side, reply_side = kind.isin("user", "tool_result"), kind.isin("assistant", "tool_use", "reasoning")
    rows = rows.filter((n > 0) & (prompt_side | reply_side)).withColumn("row_no", F.col("index")) \
        .withColumn("model", F.coalesce("cur", F.lit("<unknown>")))
    return _layout(rows, "cursor", {
        "input_tokens": F.when(prompt_side, n).otherwise(zero),
        "output_tokens": F.when(reply_side, n).otherwise(zero),
        "reasoning_output_tokens": F.when(kind == "reasoning", n).otherwise(zero)})


def priced(usage: DataFrame, rates: DataFrame, windows: DataFrame, params: CostParams = CostParams()) -> DataFrame:
    """Adds ``cost_usd`` (null when unknown) and ``context_pct`` to every usage row."""
    c = F.col
    df = pricing.with_model_facts(usage, rates, windows)
    cost = pricing.usage_cost(c("prompt_tokens"), c("billable_input"), c("cached_read_tokens"),
                              c("cached_create_tokens"), c("create_5m"), c("create_1h"), c("output_tokens"),
                              c("reasoning_output_tokens"), params)
    window = F.coalesce(c("window_hint"), c("context_window"))
    pct = F.when((window > 0) & (c("prompt_tokens") > 0), c("prompt_tokens") / window * 100)
    return df.withColumns({"cost_usd": F.when(c("priced"), cost), "context_pct": pct}).drop("rate", "context_window")


def usage_points(rows: DataFrame) -> DataFrame:
    """One timestamped sample per priced row (AG19)."""
    cost = F.coalesce(F.col("embedded_cost"), F.col("cost_usd"), F.lit(0)).cast("decimal(18,6)")
    return rows.filter(F.col("ts_ms") > 0).select("trace_id", "row_no", "ts_ms", "agent", "model", *TOKEN_COLUMNS,
                                                  cost.alias("cost_usd"))


def session_tokens(rows: DataFrame) -> DataFrame:
    """Token totals per session as sums of the rows; the total is finalised once more on the sums."""
    return finalise_totals(rows.groupBy("trace_id").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS]))


def session_cost(rows: DataFrame, params: CostParams = CostParams()) -> DataFrame:
    """Sum of the row prices; null when any row that should have a price has none. Embedded prices win."""
    unknown = F.bool_or(F.col("cost_usd").isNull() & F.col("priced"))
    total = F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(18,6)")
    cost = F.when(~unknown, total) if params.enabled else F.lit(None).cast("decimal(18,6)")
    return rows.groupBy("trace_id").agg(F.coalesce(F.sum("embedded_cost").cast("decimal(18,6)"), cost).alias("cost_usd"))


def session_cost_on_model_totals(rows: DataFrame, rates: DataFrame, params: CostParams = CostParams()) -> DataFrame:
    """One price per model on the session's totals, so that long-context tiers see the sum."""
    per = rows.groupBy("trace_id", "model").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS])
    c, zero = F.col, F.lit(0).cast("bigint")
    prompt = c("input_tokens") + c("cached_read_tokens") + c("cached_create_tokens")
    cost = pricing.usage_cost(prompt, c("input_tokens"), c("cached_read_tokens"), c("cached_create_tokens"), zero, zero,
                              c("output_tokens"), c("reasoning_output_tokens"), params)
    per = pricing.with_rates(per, rates).withColumn("cost", cost)
    return per.groupBy("trace_id").agg(
        F.when(~F.bool_or(F.col("cost").isNull()), F.sum("cost").cast("decimal(18,6)")).alias("cost_usd"))


def model_shares(rows: DataFrame, top: int = 3) -> DataFrame:
    """Largest models of each session with their share of all tokens (AG17), one row per session and model."""
    per = rows.groupBy("trace_id", "model").agg(F.sum("model_delta").alias("tokens")).filter("tokens > 0")
    total = per.groupBy("trace_id").agg(F.sum("tokens").alias("all_tokens"))
    best = ranked(per, ["trace_id"], [F.desc("tokens"), F.asc("model")], "rank", max(1, top))
    return best.join(total, "trace_id").select(
        "trace_id", "rank", "model", "tokens", (F.col("tokens") / F.col("all_tokens") * 100).alias("percent"))


def session_usage(rows: DataFrame, totals: DataFrame | None = None, cost: DataFrame | None = None,
                  estimated_shares: bool = False, top: int = 3) -> DataFrame:
    """All token measures of a session in one row."""
    shares = model_shares(rows, top).groupBy("trace_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "model", "tokens", "percent"))).alias("s"))
    shares = shares.select("trace_id", F.transform("s", lambda x: F.struct(x["model"], x["tokens"], x["percent"]))
                           .alias("model_token_shares_top"))
    pct = rows.groupBy("trace_id").agg(F.max("context_pct").alias("context_window_pct"))
    out = (totals if totals is not None else session_tokens(rows)).join(pct, "trace_id", "left") \
        .join(cost if cost is not None else session_cost(rows), "trace_id", "left").join(shares, "trace_id", "left")
    has_shares = F.col("model_token_shares_top").isNotNull()
    return out.withColumn("model_token_shares_estimated", has_shares if estimated_shares else F.lit(False))
