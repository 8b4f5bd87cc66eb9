"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from strandmill.plans import catalog

HEADLINE = [
    "tvr_load", "kmer_topk_other", "telomere_consensus", "tvr_composition", "interval_overlap", "nearest_boundary", "coverage_depth", "mapq_threshold",
    "nm_as_summary", "bound_fraction", "binned_rate", "partner_curve", "cdf_by_group", "mann_whitney_u", "wilcoxon_w", "kmer_sw_similarity",
]


def main() -> None:
    sf_dir, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
