"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from tidemark.catalog import QUERIES
from tidemark.catalog.base import candles
from tidemark.plans.experiment import search
from tidemark.plans.strategies import REGISTRY
from tidemark.session import local_session

HEADLINE = [
    "daily_candles",
    "ema_10_20",
    "volatility_rank",
    "regime_turns",
    "weekly_trend_filter",
    "backtest_v5",
    "grid_search_v5",
    "holdout_v2",
    "live_signals",
    "managed_quantity",
    "execution_metrics",
    "weighted_positions",
    "reconciled_orders",
    "drift_alerts",
    "request_errors",
    "stream_signal_dedup",
]
# The published research grid: 4 * 3 * 3 * 3 * 3 * 3 * 3 = 2,916 combinations per market.
FULL_GRID = {
    "regime_ema_len": "80:200:40",
    "atr_period": "10:18:4",
    "atr_mult_low_vol": "1.5:2.5:0.5",
    "atr_mult_high_vol": "3.0:4.0:0.5",
    "vol_regime_lookback": "20:40:10",
    "vol_regime_threshold": "0.6:0.8:0.1",
    "regime_band": "0.01:0.03:0.01",
}


def full_grid(spark, sf):
    strategy = REGISTRY.get("v5")
    return search(strategy, candles(spark, sf), strategy.grid(**FULL_GRID), 5)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).agg(F.sum("id")).collect()
    plans = {n: QUERIES[n] for n in HEADLINE} | {"grid_search_v5_2916": full_grid}
    only = sys.argv[1:]
    took = {}
    for name, build in plans.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        build(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
