"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["bbox_filter_points", "bbox_filter_events", "bbox_filter_lines", "bounds_profile", "join_points_in_polygons",
            "join_within_boxes", "join_distance", "join_polygons", "cluster_points", "cluster_points_zooms",
            "classify_graduated", "classify_graduated_histogram", "classify_categorized", "line_length",
            "decode_vertices", "dataset_create"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate())
    from mapframe.plans import workload

    cold, warm = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
