"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.  The staged and the feature
layer are timed as entries of their own; later queries scan them, as in a real job.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opsreliability.catalog import load  # noqa: E402
from opsreliability.catalog.base import Tables  # noqa: E402
from opsreliability.catalog.features import features  # noqa: E402
from opsreliability.session import build_session  # noqa: E402

HEADLINE = [
    "km1_kpi_overview", "km2_kpi_carrier_month", "km3_kpi_airport_month", "km4_kpi_route",
    "km6_delay_causes_month", "km8_daily_network", "km9_daily_airport", "km10_airport_profile",
    "dq1_to_dq26_checks", "sg3_airport_dim", "wn1_peer_counts", "wn3_gap_to_previous",
    "wn2_sequence_in_hot_groups", "fe9_target_encoding", "fe16_split_summary",
    "ag4_whole_table_quantiles", "or4_fixed_sample_after_filter", "ev1_roc_auc",
    "ev2_average_precision", "ev5_top_slice", "se3_series_features_volume",
    "se6_backtest_baselines_rate", "an2_network_disruption_days", "an6_isolation_forest",
    "sc2_request_features", "sm2_risk_bands", "me1_to_me22_by_carrier",
    "me23_to_me25_month_over_month", "me27_route_vs_network", "rq12_by_route",
    "ml2_logistic", "ml4_boosted",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    timed("layer_staged_legs", lambda: Tables(spark, folder).staged)
    timed("layer_features", lambda: features(Tables(spark, folder)))
    only = sys.argv[1:]
    for name in HEADLINE:
        if not only or any(name.startswith(o) for o in only):
            timed(name, lambda: queries[name](spark, folder).write.format("noop")
                  .mode("overwrite").save())
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total_seconds",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
