"""Ordered running values that stay parallel inside one huge group.

A window over a whole session would put that session into one task. Every helper here cuts each group into
order-consistent chunks, runs the window inside the chunk, folds each chunk to one summary row (map-side combined),
carries the summaries along, and joins the carry back on (group, chunk). The window and the join share one exchange.
"""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_ROWS = 100_000
_C, _FIRST = "__chunk", "__chunk_first"


def running(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, Column | None]],
            chunk_rows: int = CHUNK_ROWS, tie: list[str] | None = None, chunk: Column | None = None) -> DataFrame:
    """Add running columns.

    ``order`` is a whole number; rows of equal ``order // chunk_rows`` form a chunk, ``tie`` breaks equal orders.
    ``chunk`` names the chunk instead when the order itself says nothing about chunk sizes.
    A spec is (kind, value): ``last`` latest non-null value up to and including this row, ``last_before`` up to the
    row before, ``first`` first non-null value so far, ``sum`` running sum, ``lag`` value of the row before, ``count``
    running row number.
    """
    srt = [order] + (tie or [])
    at = F.struct(*srt)
    src = df.withColumn(_C, F.floor(F.col(order) / chunk_rows).cast("bigint") if chunk is None else chunk)
    for name, (kind, value) in specs.items():
        if value is not None:
            src = src.withColumn(f"__v_{name}", value)
    part = W.partitionBy(*keys, _C).orderBy(*srt)
    upto, before = part.rowsBetween(W.unboundedPreceding, 0), part.rowsBetween(W.unboundedPreceding, -1)
    prior = W.partitionBy(*keys).orderBy(_C).rowsBetween(W.unboundedPreceding, -1) if keys else \
        W.orderBy(_C).rowsBetween(W.unboundedPreceding, -1)

    local, folds, carries, finals = {}, [], {}, {}
    for name, (kind, _) in specs.items():
        v, t, c = F.col(f"__v_{name}"), f"__t_{name}", f"__c_{name}"
        if kind in ("last", "last_before"):
            local[name] = F.last(v, True).over(upto if kind == "last" else before)
            folds.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(t))
            carries[c] = F.last(t, True).over(prior)
            finals[name] = F.coalesce(F.col(name), F.col(c))
        elif kind == "first":
            local[name] = F.first(v, True).over(upto)
            folds.append(F.min_by(v, F.when(v.isNotNull(), at)).alias(t))
            carries[c] = F.first(t, True).over(prior)
            finals[name] = F.coalesce(F.col(c), F.col(name))
        elif kind == "sum":
            local[name] = F.sum(v).over(upto)
            folds.append(F.sum(v).alias(t))
            carries[c] = F.sum(t).over(prior)
            finals[name] = F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
        elif kind == "count":
            local[name] = F.row_number().over(part).cast("bigint")
            folds.append(F.count(F.lit(1)).alias(t))
            carries[c] = F.sum(t).over(prior)
            finals[name] = F.col(name) + F.coalesce(F.col(c), F.lit(0))
        elif kind == "lag":
            local[name] = F.lag(v).over(part)
            folds.append(F.max_by(v, at).alias(t))
            carries[c] = F.last(t).over(prior)
            finals[name] = F.when(F.col(_FIRST), F.col(c)).otherwise(F.col(name))
        else:
            raise ValueError(kind)
    folded = src.groupBy(*keys, _C).agg(*folds)
    folded = folded.select(*keys, _C, *[e.alias(c) for c, e in carries.items()])
    rows = src.withColumns(local)
    if any(kind == "lag" for kind, _ in specs.values()):
        rows = rows.withColumn(_FIRST, F.row_number().over(part) == 1)
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) if k != _C else F.col(f"r.{k}") == F.col(f"s.{k}")
          for k in [*keys, _C]]
    cond = on[0]
    for extra in on[1:]:
        cond = cond & extra
    joined = rows.alias("r").join(folded.alias("s"), cond, "left").select("r.*", *[f"s.{c}" for c in carries])
    return joined.withColumns(finals).select(*[c for c in df.columns if c not in specs], *specs)


def dense_index(df: DataFrame, keys: list[str], order: str, out: str = "index", chunk_rows: int = 1_000_000,
                tie: list[str] | None = None) -> DataFrame:
    """1-based running number inside each group."""
    return running(df, keys, order, {out: ("count", None)}, chunk_rows, tie)


def attach_by_chunk(rows: DataFrame, stats: DataFrame, key: str, index: str, count: str,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Join one stats row per group to the group's many rows without a hot join key.

    ``stats.count`` is the number of rows of the group and ``rows.index`` their dense number, so a stats row is
    repeated exactly once per chunk of its group and small groups are not repeated at all.
    """
    left = rows.withColumn(_C, F.floor((F.col(index) - 1) / chunk_rows).cast("bigint"))
    right = stats.withColumn(_C, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                      F.floor((F.col(count) - 1) / chunk_rows).cast("bigint"))))
    return left.join(right, [key, _C]).drop(_C)


def ensure_checkpoint_dir(spark) -> None:
    """Use the folder named by the session. On a local master without one (tests) take one of our own; on a cluster that would be
    a folder of one machine, so it is an error there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            configured = tempfile.mkdtemp(prefix="run-")
        sc.setCheckpointDir(configured)


_SCRATCH: dict[str, set[str]] = {}


def scratch_dir(spark) -> str:
    """A fresh folder next to the checkpoints, which all executors share; removed by ``release`` or when the session ends."""
    ensure_checkpoint_dir(spark)
    app = spark.sparkContext.applicationId
    path = f"{spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4().hex}"
    if app not in _SCRATCH:
        _SCRATCH[app] = set()
        atexit.register(release, spark)
    _SCRATCH[app].add(path)
    return path


def scratch_mark(spark) -> set[str]:
    """The scratch folders there are now, for ``release``."""
    return set(_SCRATCH.get(spark.sparkContext.applicationId, ()))


def release(spark, since: set[str] | None = None) -> int:
    """Remove the scratch folders made after ``since`` (all without it), once nothing reads them any more; returns how many."""
    jvm, made = spark._jvm, _SCRATCH.get(getattr(spark.sparkContext, "applicationId", ""), set())
    if jvm is None or spark.sparkContext._jsc is None:
        return 0
    gone = [p for p in made if since is None or p not in since]
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        made.discard(path)
    return len(gone)


def staged(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared folder, to be read several times with only the columns needed.

    Used where parsing is dear and several ordered passes follow; the table also ends the lineage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Rank of every row over the whole table without a single-task window.

    The order must be total. Rows are range-sorted and checkpointed, so that positions stay the same when a lost task
    is run again; only the row counts of the partitions are carried along.
    """
    ensure_checkpoint_dir(df.sparkSession)
    pos = df.orderBy(*order).withColumn("__pos", F.monotonically_increasing_id()).checkpoint()
    pos = pos.withColumn("__part", F.shiftright("__pos", 33))
    counts = pos.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select("__part", F.coalesce(
        F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    # one row per partition of the sorted table, a proven small side
    return (pos.join(F.broadcast(base), "__part")
            .withColumn(out, F.col("__base") + F.col("__pos") - F.shiftleft(F.col("__part"), 33) + 1)
            .drop("__part", "__pos", "__base"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], out: str, limit: int) -> DataFrame:
    """First ``limit`` rows per group; Spark prunes each input partition to its own top rows before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(w).cast("bigint")).filter(F.col(out) <= limit)
