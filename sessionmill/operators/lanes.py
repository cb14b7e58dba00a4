"""First-fit lanes of timeline bars (WF10)."""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T


def _assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lowest free lane for each bar of a sorted stream; keeps the busy lanes only, never the bars."""
    group, busy, free, lanes = None, [], [], 0
    for pdf in batches:
        out = []
        for key, first, last in zip(pdf["grp"], pdf["first_bin"], pdf["last_bin"]):
            if key != group:
                group, busy, free, lanes = key, [], [], 0
            while busy and busy[0][0] < first:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, lanes = lanes, lanes + 1
            heapq.heappush(busy, (last, lane))
            out.append(lane)
        yield pdf.assign(lane=pd.Series(out, index=pdf.index, dtype="int64"))


def assign_lanes(bars: DataFrame, timeline: list[str]) -> DataFrame:
    """Adds ``lane`` to bars (first_bin, last_bin, trace_id) of each timeline, in order of start and trace id.

    The order of first-fit is sequential only while bars overlap: where no bar is running all lanes are free again. Each
    such stretch is therefore placed on its own, streamed through its task in sorted batches.
    """
    per_bin = bars.groupBy(*timeline, "first_bin").agg(F.max("last_bin").alias("reach"))
    w = W.partitionBy(*timeline).orderBy("first_bin")
    gap = F.coalesce((F.col("first_bin") > F.max("reach").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(0))
    stretch = per_bin.withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(w)).select(*timeline, "first_bin", "stretch")
    rows = bars.join(stretch, [*timeline, "first_bin"]).withColumn("grp", F.to_json(F.struct(*timeline, "stretch")))
    rows = rows.repartition("grp").sortWithinPartitions("grp", "first_bin", "trace_id")
    schema = T.StructType([*rows.schema.fields, T.StructField("lane", T.LongType())])
    return rows.mapInPandas(_assign, schema).drop("grp", "stretch")
