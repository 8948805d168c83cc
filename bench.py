"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; the last line is one JSON object."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ("t6_cosine_to_query", "t8_filter_by_relevance", "t9_rank_by_relevance", "t12_similar_pairs", "t3_word_ngrams", "w2_filter_then_best", "b7_post_filter", "g9_bundles", "k2_status_per_window", "c8_w6_extract_by_selectors", "m1_extract", "t13_j4_drop_near_duplicates")


def main() -> None:
    from serpflow.queries import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", 4 * int(cpus))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
