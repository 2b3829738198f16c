"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from regionloom.plans import catalog
from regionloom.session import build_session

HEADLINE = [
    "near_county_compare",
    "yearly_means",
    "distance_stats",
    "frequency_bins",
    "quantiles_by_source",
    "column_summary",
    "correlation_pairs",
    "keyed_cross_correlation",
    "regression_summary",
    "profile_columns",
    "number_rows_by_key",
    "align_by_position",
    "sample_uncertainty",
    "poisson_bootstrap_means",
    "group_bias",
    "nearest_distance",
    "counts_within_radii",
    "geometry_intersections",
    "knn_graph",
    "points_in_polygons",
    "hull_extents",
    "spacetime_overlap",
    "risk_surface",
    "spatial_interpolation",
    "linear_regression_metrics",
    "naive_bayes_metrics",
    "kmeans_clusters",
    "pca_explained",
    "fourier_by_source",
    "arima_110",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["near_county_compare"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # a failed query must not hide the others
            print(f"{name}: {str(error)[:300]}", file=sys.stderr)
            times[name] = -1.0
    scale = os.path.basename(folder.rstrip("/")).replace("sf", "")
    total = round(sum(t for t in times.values() if t > 0), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
