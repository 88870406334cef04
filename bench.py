"""Time the headline queries; prints one JSON line.

Each query runs once to warm the JVM and once timed. Environment: BENCH_SF_DIR, BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import time

from panelloom.catalogue import QUERIES
from panelloom.session import local_session

HEADLINE = (
    "scaled_anomaly_quarter",
    "all_norms_long",
    "weighted_region_index",
    "trailing_norm",
    "price_panel",
    "seasonal_adjust_classical",
    "anchored_extrapolation",
    "per_capita_ratio",
    "merge_panel",
    "kde_season",
    "summary_stats",
    "last_rows_per_group",
    "group_id",
    "fold_text",
    "fe_ols_1",
    "lp_irf",
    "long_run",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            # Every row is computed; none is kept.
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
