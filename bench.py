"""Headline queries on $BENCH_SF_DIR with $BENCH_CPUS cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# selection, normalising, point lookups, relief, mesh, tiles, checks, logs: the stages the baseline times
HEADLINE = (
    "f01_radius_selection", "c35_site_selection", "a05_layer_summary", "c02_normalize_buildings", "c04_building_height",
    "j01_regulation_at_point", "j04_zones_near_point", "j10_nearest_rail", "j12_zone_overlaps", "j13_network_clearance", "j18_bilinear_sample",
    "a07_cut_fill", "w02_zone_versions", "w05_box_smoothing", "c29_overlay_blend", "g01_tiles_covering_circle", "g11_grid_faces", "s09_site_dataset_sink",
    "a22_job_status", "j22_peak_per_step", "w01_latest_per_source", "c36_request_deadlines",
)


def main() -> None:
    from driver import catalog
    from sitewright.session import local_session

    spark = local_session(CPUS, "bench", shuffle_partitions=max(int(CPUS) if CPUS.isdigit() else 8, 8))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the workers
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
