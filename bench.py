"""Headline queries, timed once each after a warm-up; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankloom.catalog import QUERIES  # noqa: E402
from rankloom.lineage import clean  # noqa: E402
from rankloom.sources.derived import Derived  # noqa: E402

HEADLINE = (
    "A05_health_score", "A06_cannibalization", "G04_consolidation_plan", "G05_pruning_plan", "W02_date_trends", "W04_content_tracking",
    "A23_content_verdict", "J19_cosine_pairs", "G01_threshold_components", "G02_linkage_clusters", "A12_link_tier", "A11_anchor_collisions",
    "J13_keyword_near_match", "M01_tfidf_vectors", "A18_entity_site_summary", "A19_site_run_summary",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["A06_cannibalization"](Derived(spark, folder)).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](Derived(spark, folder)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        clean(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
