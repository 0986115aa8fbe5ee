"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.  Every query is
planned and run to the end with a sink that discards rows; one untimed query warms the session up.
BENCH_ALL=1 times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from motionlake.plans.catalog import REGISTRY  # noqa: E402
from motionlake.session import local_session  # noqa: E402

HEADLINE = [
    "a08_unpivot_tests",
    "a17_valid_sprints",
    "a18_velocity_decrement",
    "a19_load_summary",
    "b09_metric_categories",
    "c01_metric_profile",
    "c03_completeness_matrix",
    "c04_coverage_scores",
    "d01_entity_matrix",
    "d05_correlations",
    "d13_component_scores",
    "d15_kmeans_clusters",
    "d16_silhouette_given_labels",
    "e02_first_to_last",
    "e07_improvement_report",
    "e07_improvement_report_daily",
    "f01_entity_profiles",
    "f04_head_to_head",
    "g02_session_stats",
    "g05_session_trend_lines",
    "g07_baseline_progression",
    "g09_team_periods",
    "h01_athlete_features",
    "h04_similar_athletes",
    "h08_training_zones",
    "h12_power_endurance",
    "h13_injury_risk",
    "h14_force_velocity_profiles",
    "h16_profile_shift",
    "h17_speed_forecast",
    "i02_signed_asymmetry_by_session",
    "i04_load_matched_asymmetry",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sorted(REGISTRY) if os.environ.get("BENCH_ALL") else HEADLINE
    REGISTRY["g09_team_periods"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
