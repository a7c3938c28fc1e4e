"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelmill.plans import load_queries  # noqa: E402
from panelmill.session import build_session  # noqa: E402

HEADLINE = [
    "sma_features", "ema_macd", "rsi", "bollinger", "stoch_willr_cci", "volume_indicators", "price_momentum", "unified_indicators", "market_regime",
    "tick_indicators", "microstructure", "asof_macro", "asof_quotes", "daily_sentiment", "sentiment_momentum", "news_volume",
    "sentiment_market_alignment", "align_sentiment_mean", "calendar_fill", "interpolate_limit", "dedup_clean", "quality_report",
    "backtest_equity", "backtest_metrics", "backtest_trades", "param_sweep", "forecast_metrics", "lag_alignment", "naive_forecast", "ml_ridge",
    "unified_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, app="panelmill-bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = load_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().collect()  # start the engine
    took: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {took[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
