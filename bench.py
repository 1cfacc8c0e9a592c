"""Time the headline queries: one JSON line on stdout.

The derived input tables (cells, measurements, relations) are prepared first and timed as
``prepare``; each query then runs from those tables to its full result.
"""

from __future__ import annotations

import json
import os
import time

from cellscape.plans.queries import QUERIES
from cellscape.session import local_session
from cellscape.sources import bench_tables as tables

HEADLINE = [
    "competition_counts",
    "undershoot_candidates",
    "undershoot_uptilt",
    "overshoot_cells",
    "overshoot_env_cells",
    "interference_kring",
    "interference_clusters",
    "low_coverage_clusters",
    "coverage_gaps",
    "pci_confusions",
    "pci_collisions",
    "pci_blacklist",
    "feeder_cells",
    "hull_build",
    "tilt_rsrp_scenarios",
    "rsrp_idw_fill",
    "site_environment",
    "daily_resolution",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, shuffle_partitions=max(8, int(cores)) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    start = time.time()
    for build in (tables.cell_gis, tables.coverage, tables.relations):
        build(spark, sf_dir)
    seconds["prepare"] = round(time.time() - start, 2)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
