"""Rates, context windows and the price of usage rows (JN03, JN04, JN16, AG15)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import pricing_model
from ..params import DEFAULT_CONTEXT_WINDOW, DEFAULT_RATES, DEFAULT_WINDOWS, RATE_COLUMNS, CostParams

_RATE = "decimal(12,6)"


def _sql_values(rows: tuple) -> str:
    def lit(x) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def rate_values() -> str:
    """The default rate table as a VALUES list with its order number."""
    return _sql_values(tuple((i, *r) for i, r in enumerate(DEFAULT_RATES)))


def rate_table(spark: SparkSession, rows: tuple = DEFAULT_RATES) -> DataFrame:
    """Rate table as a local relation: its size is known to the optimiser, which decides on broadcasting by it."""
    cols = ", ".join(("ord", *RATE_COLUMNS))
    values = _sql_values(tuple((i, *r) for i, r in enumerate(rows)))
    casts = [F.col("ord").cast("int"), "model"] + [F.col(c).cast(_RATE).alias(c) for c in RATE_COLUMNS[1:8]]
    casts += [F.col("long_threshold").cast("bigint").alias("long_threshold")]
    casts += [F.col(c).cast(_RATE).alias(c) for c in RATE_COLUMNS[9:16]]
    casts += [F.col("context_window_tokens").cast("bigint").alias("context_window_tokens")]
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({cols})").select(*casts)


def window_table(spark: SparkSession, rows: tuple = DEFAULT_WINDOWS) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_sql_values(rows)} AS t(model, window_tokens)").select(
        "model", F.col("window_tokens").cast("bigint").alias("window_tokens"))


def overlay(defaults: DataFrame, user: DataFrame, key: str = "model", order: str = "ord") -> DataFrame:
    """User rows replace defaults of the same key, new keys follow after the defaults in user order."""
    cols = [c for c in defaults.columns if c not in (key, order)]
    d, u = defaults.alias("d"), user.alias("u")
    pick = [F.when(F.col(f"u.{key}").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in cols]
    size = defaults.agg(F.max(order) + 1).scalar()
    place = F.coalesce(F.col(f"d.{order}"), F.col(f"u.{order}") + size)
    return d.join(u, F.col(f"d.{key}") == F.col(f"u.{key}"), "full").select(
        place.alias(order), F.coalesce(f"u.{key}", f"d.{key}").alias(key), *pick)


_PARTS = ("input_rate", "cached_read_rate", "cached_create_5m_rate", "cached_create_1h_rate", "cached_create_rate",
          "output_rate", "reasoning_rate")


def _compiled(rates: DataFrame) -> DataFrame:
    """Adds the two price sets of a rate, ``base`` and ``long``, in whole millionths and with all fallbacks applied."""
    c = F.col
    create = {"": c("cached_create_rate"), "long_": F.coalesce("long_cached_create_rate", "cached_create_rate")}

    def price(name: str, tier: str) -> Column:
        own = F.coalesce(f"long_{name}", name) if tier else c(name)
        value = F.coalesce(own, create[tier]) if name.startswith("cached_create_") else own
        return (F.coalesce(value, F.lit(0)) * 1_000_000).cast("bigint").alias(name)

    return rates.withColumns({"base": F.struct(*[price(n, "") for n in _PARTS]), "long": F.struct(*[price(n, "long_") for n in _PARTS])})


def _first_per_model(table: DataFrame, order: str) -> DataFrame:
    table = _compiled(table)
    cols = [c for c in table.columns if c != "model"]
    return table.groupBy("model").agg(F.min_by(F.struct(*cols), order).alias("hit"))


def with_rates(usage: DataFrame, rates: DataFrame, model: str = "model") -> DataFrame:
    """Left join of the rate struct: exact model id first, then the normalised id."""
    hits = _first_per_model(rates, "ord")
    exact = hits.select(F.col("model").alias("__k1"), F.col("hit").alias("__exact"))
    norm = hits.select(F.col("model").alias("__k2"), F.col("hit").alias("__norm"))
    raw = F.trim(F.col(model))
    return (usage.join(exact, raw == F.col("__k1"), "left")
            .join(norm, pricing_model(raw) == F.col("__k2"), "left")
            .withColumn("rate", F.coalesce("__exact", "__norm"))
            .drop("__k1", "__k2", "__exact", "__norm"))


def model_facts(rates: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per model known to either table: its rate struct and its window. As small as the two tables."""
    w = windows.filter("window_tokens > 0").groupBy("model").agg(F.first("window_tokens").alias("window"))
    return _first_per_model(rates, "ord").withColumnRenamed("hit", "rate").join(w, "model", "full")


def with_model_facts(usage: DataFrame, rates: DataFrame, windows: DataFrame, model: str = "model",
                     default: int = DEFAULT_CONTEXT_WINDOW) -> DataFrame:
    """Adds ``rate`` and ``context_window``: by exact model id, else by the normalised id (JN03, JN04).

    The id is normalised only where the exact one leaves something open. Window: window table, then the rate's own,
    then the default.
    """
    facts = model_facts(rates, windows)
    raw = F.trim(F.col(model))
    exact = facts.select(F.col("model").alias("__k1"), F.col("rate").alias("__r1"), F.col("window").alias("__w1"))
    norm = facts.select(F.col("model").alias("__k2"), F.col("rate").alias("__r2"), F.col("window").alias("__w2"))
    df = usage.join(exact, raw == F.col("__k1"), "left")
    df = df.withColumn("__norm", F.when(F.col("__r1").isNull() | F.col("__w1").isNull(), pricing_model(raw)))
    df = df.join(norm, F.col("__norm") == F.col("__k2"), "left").withColumn("rate", F.coalesce("__r1", "__r2"))
    own = F.when(F.col("rate.context_window_tokens") > 0, F.col("rate.context_window_tokens"))
    window = F.coalesce("__w1", "__w2", own, F.lit(max(0, default)).cast("bigint"))
    return df.withColumn("context_window", window).drop("__k1", "__k2", "__r1", "__r2", "__w1", "__w2", "__norm")


def usage_cost(prompt: Column, inp: Column, read: Column, create: Column, create_5m: Column, create_1h: Column,
               out: Column, reasoning: Column, params: CostParams = CostParams()) -> Column:
    """Price of one usage row from its ``rate`` struct, rounded to micro-dollars; null when not priced."""
    if not params.enabled:
        return F.lit(None).cast("decimal(18,6)")
    zero = F.lit(0).cast("bigint")
    long = F.coalesce((F.col("rate.long_threshold") > 0) & (prompt > F.col("rate.long_threshold")), F.lit(False))
    pos = [F.greatest(t.cast("bigint"), zero) for t in (inp, read, create_5m, create_1h, create, out, reasoning)]
    pos[4] = F.greatest(pos[4] - pos[2] - pos[3], zero)
    price = [F.when(long, F.col(f"rate.long.{n}")).otherwise(F.col(f"rate.base.{n}")) for n in _PARTS]

    def total(typ: str) -> Column:
        return reduce(lambda a, b: a + b, [t.cast(typ) * p.cast(typ) for t, p in zip(pos, price)])

    # seven products of at most 1e9 tokens and 1e9 millionths of a rate stay in 64 bits; wide decimals take all other rows
    usual = (F.greatest(*pos) <= 1_000_000_000) & F.coalesce(F.greatest(*price) <= 1_000_000_000, F.lit(True))
    micro = F.lit("0.000001").cast("decimal(7,6)")
    narrow = F.call_function("div", total("bigint") + 500_000, F.lit(1_000_000).cast("bigint")).cast("decimal(18,0)") * micro
    wide = F.round(total("decimal(19,0)") * F.lit("0.000000000001").cast("decimal(12,12)"), 6)
    cost = F.when(usual, narrow.cast("decimal(18,6)")).otherwise(wide.cast("decimal(18,6)"))
    unknown = F.lit(0).cast("decimal(18,6)") if params.unknown_model_policy == "zero" else \
        F.lit(None).cast("decimal(18,6)")
    return F.when(F.col("rate").isNull(), unknown).otherwise(cost)
