"""Any JSON lines: every object row becomes a meta event (NO09)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions import text as X
from ...functions import times
from ...functions import variants as V
from .common import by_class, to_events


def normalize(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    df = rows.withColumns({"ts_ms": times.guess_ts("v"), "item_no": F.lit(0).cast("bigint"), "sid": F.lit("")})
    typ = V.first_filled(V.text(v, "$.type"), F.lit("event"))
    return to_events(by_class(df, [("meta", F.lit(True), {
        "event_kind": "meta", "raw_type": typ, "role": "system", "preview": X.preview(typ)})]), inherit=False)
