"""Headline queries, timed one after another; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from shortlens.catalog import QUERIES

HEADLINE = [
    "d12_hiring_rate",
    "d9_nest",
    "d10_field_value_counts",
    "d11_histogram_by_segment",
    "e2_top_words",
    "h9_words",
    "h26_pipeline",
    "h7_remove_stopwords",
    "h23_job_cards",
    "h34_repair_record",
    "h36_to_jobs_parsed",
    "c14_similar_pairs",
    "e5_knn",
    "d15_mean_intra_similarity",
    "i5_similarity_clusters",
    "i6_density_clusters",
    "i8_soft_clusters",
    "i12_name_clusters",
    "i15_silhouette",
    "i19_map_points",
]


def main():
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("shortlens-bench")
    options = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        "spark.sql.session.timeZone": "UTC",
    }
    for name, value in options.items():
        builder = builder.config(name, value)
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shortlens-bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
