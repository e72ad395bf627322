"""Time the registered queries on the driver's tables and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyspark.plans.queries import REGISTRY  # noqa: E402
from tallyspark.session import build_session  # noqa: E402

# One query per operator family; BENCH_ALL=1 times every registered query.
HEADLINE = (
    "kpi_totals", "daily_sales", "daily_sales_filled", "avg_daily_by_product", "product_top", "week_over_week", "peak_hour",
    "rolling_band_anomalies", "anomalies_iqr", "anomalies_by_product", "stock_snapshot", "inventory_risk_levels",
    "slow_movers_sales_rate", "zero_velocity_products", "alert_centre", "alert_rollup", "generated_insights", "clean_sales",
    "profile_columns", "ml_features", "forecast_trend_seasonal", "forecast_autoregressive", "forecast_holt_winters",
    "backtest_accuracy",
)


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(REGISTRY) if os.environ.get("BENCH_ALL") else list(HEADLINE)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
