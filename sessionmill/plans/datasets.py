"""Adapters that give the driver's tables the shape of session logs.

``events``: one row is one session event; the user is the session. ``conversations``: one turn is one untimed event.
Both are plain projections; only ``indexed`` and ``sessions`` shuffle.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.tools import kind_of_role
from ..operators import sessions as S
from ..operators.ordered import dense_index, running
from ..operators.pricing import rate_table, window_table
from ..operators.usage_rows import priced
from ..schemas import AGENT_KINDS

# Fixed values of the test data: model names by user, with vendor prefixes and dates; the last one has no rate.
MODELS = ("gpt-5.2-codex", "openai/gpt-5.4-2026-03-05", "global.anthropic.claude-opus-4-6-v1",
          "anthropic/claude-sonnet-4-6", "house-model")
NOW_MS = 1_706_659_200_000  # 2024-01-31, after the last event
WAIT_TEXT = "Would you like me to continue?"


_KEYS = {"events": ["event_id"], "documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables as it lies. ``sessionmill.tables.spread`` names a number of partitions over which test tables of
    one small file are dealt by their key; it is unset unless the caller asks for it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = int(spark.conf.get("sessionmill.tables.spread", "0"))
    return df.repartition(spread, *_KEYS[name]) if spread and name in _KEYS else df


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events. ``index`` is the event id: unique and increasing per session, not dense."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    typ, user = F.col("event_type"), F.col("user_id")
    kind = (F.when(typ == "view", "assistant").when(typ == "click", "tool_use")
            .when(typ.isin("purchase", "error"), "tool_result").when(typ == "signup", "user").otherwise("meta"))
    tool = kind.isin("tool_use", "tool_result")
    name = F.concat(F.lit("tool_"), k % 9)
    return e.select(
        user.cast("string").alias("trace_id"), F.col("event_id").alias("index"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("ts_ms"),
        _pick(AGENT_KINDS, user % 7).alias("agent"),
        F.when(user % 10 == 0, "").otherwise(F.concat(F.lit("sess-"), user)).alias("session_id"),
        kind.alias("event_kind"), typ.alias("raw_type"), (typ == "error").alias("has_error"), k.alias("k"),
        F.when(tool, k.cast("string")).otherwise("").alias("tool_use_id"),
        F.when(tool, k.cast("string")).otherwise("").alias("tool_call_id"),
        F.when(kind == "tool_use", name).otherwise("").alias("tool_name"), F.lit("").alias("function_name"),
        F.when(tool, F.concat(F.lit("type_"), k % 4)).otherwise("").alias("tool_type"),
        F.concat(user, F.lit(":"), F.col("event_id")).alias("event_id"),
        F.when((kind == "assistant") & (k % 11 == 0), WAIT_TEXT)
        .otherwise(F.concat(typ, F.lit(" "), k)).alias("preview"),
        _pick(MODELS, user % 5).alias("model"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"), (k * 10).alias("cached_read_tokens"),
        F.floor(F.col("value") * 20).cast("bigint").alias("output_tokens"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a dense 1-based ``index`` per session; the event id stays as ``seq``."""
    e = events(spark, sf_dir).withColumnRenamed("index", "seq")
    return dense_index(e, ["trace_id"], "seq")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session rows with the summary measures that need no order inside the session."""
    e = events(spark, sf_dir)
    out = e.groupBy("trace_id").agg(
        F.first("agent").alias("agent"), F.first("session_id").alias("session_id"), *S.count_measures(),
        *S.file_order_bounds(), (F.max("ts_ms") + 1000).alias("mtime_ms"))
    path = F.concat(F.lit("/logs/"), F.col("agent"), F.lit("/"), F.col("trace_id"), F.lit(".jsonl"))
    return out.withColumn("path", path)


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage row per event in the common layout."""
    e = events(spark, sf_dir)
    c, zero = F.col, F.lit(0).cast("bigint")
    return e.select("trace_id", "agent", c("index").alias("row_no"), "ts_ms", "model", "input_tokens",
                    "cached_read_tokens", zero.alias("cached_create_tokens"), "output_tokens",
                    zero.alias("reasoning_output_tokens"),
                    (c("input_tokens") + c("cached_read_tokens") + c("output_tokens")).alias("total_tokens"),
                    zero.alias("create_5m"), zero.alias("create_1h"),
                    (c("input_tokens") + c("cached_read_tokens")).alias("prompt_tokens"),
                    c("input_tokens").alias("billable_input"), F.lit(None).cast("bigint").alias("window_hint"),
                    F.lit(True).alias("priced"),
                    F.when(c("k") % 3 == 0, (c("k") / 1000).cast("decimal(18,6)")).alias("embedded_cost"),
                    (c("input_tokens") + c("cached_read_tokens") + c("output_tokens")).alias("model_delta"), "k")


def priced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(usage_rows(spark, sf_dir), rate_table(spark), window_table(spark))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage points of the event sessions, unknown prices as 0."""
    return priced_rows(spark, sf_dir).withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0)).cast("decimal(18,6)"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as untimed events."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").cast("string").alias("trace_id"), (F.col("turn") + 1).alias("index"),
                    F.lit(None).cast("bigint").alias("ts_ms"), kind_of_role(F.col("role")).alias("event_kind"), "role",
                    F.col("text").alias("preview"), F.array("text").alias("text_blocks"),
                    F.when(F.col("turn") % 4 == 1, _pick(MODELS, F.col("conv_id") % 5)).otherwise("")
                    .alias("event_model"))
