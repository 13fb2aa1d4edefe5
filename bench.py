"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from gridcast.plans import catalog  # noqa: F401
from gridcast.plans.registry import runner
from gridcast.session import build_session, drop_staged

HEADLINE = [
    "j1_side_expansion",
    "a1_asof_points",
    "a7_team_strength",
    "a8_strength_timeline",
    "a15_turnover_form",
    "a16_schedule_factor",
    "f1_baseline_forecast",
    "walk_forward_brier",
    "e5_bootstrap_interval",
    "e7_metrics_grouping_sets",
    "e8_walk_forward",
    "e11_margin_walk_forward",
    "e18_paired_significance",
    "c1_exponent_fit",
    "p3_usual_starters",
    "p7_player_impact",
    "p11_availability",
    "w1_win_totals",
    "g2_arbitrage",
    "g4_momentum",
    "g5_backtest",
    "s7_scoreboard",
    "s3_bucketed_upsert",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    started = time.time()
    spark = build_session("gridcast-bench", f"local[{cpus}]", max(8, int(cpus) if cpus.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str) -> float:
        begin = time.time()
        runner(name)(spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - begin

    # The first query also builds the stored game table all others read.
    for name in HEADLINE:
        times[name] = round(statistics.median(timed(name) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "with_startup": round(time.time() - started, 3),
            }
        )
    )
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
