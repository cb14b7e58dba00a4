"""Times the headline queries at ``$BENCH_SF_DIR`` and prints one JSON line.

Every query runs once to warm up and is timed on its second run, into a sink that throws the rows away.
``BENCH_QUERIES`` (comma separated) picks other queries, ``BENCH_DUCKDB=1`` adds the time of the same SQL in DuckDB.
"""
from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sessionmill.plans import catalog

HEADLINE = ("overview", "fleet_report", "session_counts", "unmatched_tools", "top_tools_truncated", "tool_type_counts", "segments",
            "lifetime_bins", "usage_cost_rows", "session_cost", "context_pct", "model_shares", "cumulative_delta", "dedup_usage",
            "estimated_usage", "status_ladder", "day_bins", "week_bins", "week_usage", "year_days", "year_usage", "page_events",
            "session_pages", "event_upsert_last", "delta_coalesce", "nearest_match", "project_match", "redact_documents",
            "jsonl_scan", "normalize_codex", "normalize_claude", "entity_join")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("sessionmill-bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.variant.allowDuplicateKeys", "true").config("sessionmill.tables.spread", cpus).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times, duck = {}, {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    if os.environ.get("BENCH_DUCKDB"):
        from tests.oracle import connect
        con = connect(sf_dir)
        for name in names:
            if name in catalog.ORACLE:
                start = time.perf_counter()
                con.execute(catalog.ORACLE[name]).fetchall()
                duck[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
    if duck:
        out["duckdb"] = duck
    print(json.dumps(out))


if __name__ == "__main__":
    main()
