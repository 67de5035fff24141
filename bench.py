"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from acreage.catalog import all_entries  # noqa: E402
from acreage.session import local_session  # noqa: E402

HEADLINE = (
    "mean_price_by_country", "kpis", "city_stats", "top_cities", "price_per_sqm_by_country", "price_ranges", "area_ranges",
    "city_heatmap", "extremes", "market_insights", "summary", "country_moments", "standardise_bangladesh", "standardise_poland",
    "union_sources", "percentile_band", "clean", "remove_outliers", "with_synthetic", "missing_values", "cardinality", "describe",
    "histogram", "box_stats", "correlation", "duplicate_rows", "skew_flags", "iqr_outliers", "split_rows", "city_mean_price",
    "out_of_fold_mean", "city_labels", "robust_scale", "engineered_features", "evaluate_splits", "price_band", "score_listings",
    "user_prediction_stats", "recent_predictions", "apply_changes", "poi_within", "nearest_poi", "demand_supply",
    "safety_livability", "location_features", "price_surface", "intent_counts", "block_counts", "user_stats_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"), spark__ui__showConsoleProgress="false")
    entries = all_entries()
    entries["mean_price_by_country"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executor
    times = {}
    for name in names:
        start = time.perf_counter()
        entries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
