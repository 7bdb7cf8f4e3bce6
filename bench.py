"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from barloom.catalog import QUERIES
from barloom.session import local_session

HEADLINE = ["change_1d", "breadth", "top_movers", "clean_bars", "sma_guarded", "high_low_52w", "volume_multiple", "golden_death_cross", "scan_lists", "asof_return", "join_relative_strength", "macd_12_26_9",
            "sector_performance", "instrument_status", "annual_parse", "yoy_qoq_growth", "shareholding_categories", "merge_annual_ledger", "no_loss_candles", "dq_candles", "worklist_budget_cut", "search_symbols",
            "tick_jump_hold", "tick_latest", "live_snapshot"]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench")
    seconds = {}
    run(spark, "top_movers", sf_dir)                                  # start the JVM paths once
    for name in os.environ.get("BENCH_ONLY", ",".join(HEADLINE)).split(","):
        seconds[name] = round(min(run(spark, name, sf_dir) for _ in range(2)), 3)
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    extra = {"ticks_per_second": round(ticks / seconds["tick_jump_hold"])} if "tick_jump_hold" in seconds else {}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
