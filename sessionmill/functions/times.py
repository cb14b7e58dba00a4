"""Epoch milliseconds and fixed-offset local time (SF03, SF04, SF08, SF25, SF26, SF27)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import DAY_MS, MINUTE_MS
from . import variants as V

# Field names and nesting levels searched for a timestamp, in order of preference.
TIME_FIELDS = ("timestamp", "timestamp_ms", "timestampMs", "time", "ts", "updated_at", "updatedAt", "start_time",
               "startTime", "started_at", "startedAt", "created_at", "createdAt", "date")
TIME_LEVELS = ("$", "$.payload", "$.event", "$.message")


_EPOCH = (r"CASE WHEN trim({x}) RLIKE r'^-?\d+(\.\d+)?(E\d+)?$' AND try_cast(trim({x}) AS double) > 1e9 THEN "
          r"CASE WHEN try_cast(trim({x}) AS double) > 1e12 THEN floor(try_cast(trim({x}) AS double)) "
          r"ELSE floor(try_cast(trim({x}) AS double) * 1000 + 0.5) END "
          r"WHEN trim({x}) <> '' THEN unix_millis(try_to_timestamp(trim({x}))) END")


def epoch_ms(c: Column) -> Column:
    """Epoch milliseconds of a string: numbers above 1e12 are ms, above 1e9 seconds, else a date text; else null."""
    t = F.trim(c)
    n = F.when(t.rlike(r"^-?\d+(\.\d+)?(E\d+)?$"), t.try_cast("double"))
    return (F.when(n > 1e12, F.floor(n))
            .when(n > 1e9, F.floor(n * 1000 + 0.5))
            .when(t != "", F.unix_millis(F.try_to_timestamp(t)))
            .cast("bigint"))


def field_epoch_ms(v: Column, path: str) -> Column:
    return epoch_ms(F.try_variant_get(v, path, "string"))


def guess_ts(column: str, root: str = "$") -> Column:
    """First parsable timestamp of a variant column. The usual place is tried alone, the long tail only where it fails."""
    get = lambda path: f"try_variant_get({column}, '{path}', 'string')"
    places = ", ".join(get(f"{root}{lv[1:]}.{f}") for lv in TIME_LEVELS for f in TIME_FIELDS)
    rest = f"get(filter(transform(array({places}), x -> {_EPOCH.format(x='x')}), y -> y IS NOT NULL), 0)"
    first = get(root + ".timestamp")
    return F.expr(f"CAST(coalesce({_EPOCH.format(x=first)}, {rest}) AS bigint)")


def duration_ms(c: Column) -> Column:
    """Milliseconds of a text such as ``24h``; null when it is no duration."""
    t = F.lower(F.trim(c))
    n = F.regexp_extract(t, r"^(\d+)([smhd])$", 1)
    unit = F.regexp_extract(t, r"^(\d+)([smhd])$", 2)
    size = (F.when(unit == "s", 1000).when(unit == "m", MINUTE_MS).when(unit == "h", 60 * MINUTE_MS)
            .when(unit == "d", DAY_MS))
    return F.nullif(n, F.lit("")).cast("bigint") * size


def local_day(ms: Column, tz_offset_min: int = 0) -> Column:
    """Days since 1970-01-01 of the local date."""
    return F.floor((ms - F.lit(tz_offset_min * MINUTE_MS)) / DAY_MS).cast("int")


def local_date(ms: Column, tz_offset_min: int = 0) -> Column:
    return F.date_format(F.date_from_unix_date(local_day(ms, tz_offset_min)), "yyyy-MM-dd")


def window_start_ms(date_text: Column, tz_offset_min: int = 0) -> Column:
    return F.unix_date(F.to_date(date_text)).cast("bigint") * DAY_MS + F.lit(tz_offset_min * MINUTE_MS)


def bin_index(ts: Column, start: Column, bin_ms: Column | int, bins: Column | int) -> Column:
    """Bin of a timestamp, clamped to the window's bins."""
    size = F.lit(bin_ms) if isinstance(bin_ms, int) else bin_ms
    last = (F.lit(bins) if isinstance(bins, int) else bins) - 1
    return F.least(F.greatest(F.floor((ts - start) / size), F.lit(0)), last).cast("int")


def document_anchor_ms(v: Column) -> Column:
    """Start of a whole-document session: startTime, else the first message's time, else lastUpdated, else 0."""
    def pick(path: str) -> Column:
        x = F.when(V.is_string(V.sub(v, path)), F.unix_millis(F.try_to_timestamp(F.trim(V.text(v, path)))))
        return F.when(x > 0, x)
    return F.coalesce(pick("$.startTime"), pick("$.messages[0].timestamp"), pick("$.lastUpdated"),
                      F.lit(0)).cast("bigint")
