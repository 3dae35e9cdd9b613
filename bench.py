"""Times the headline queries; prints one JSON line."""

import json
import os
import time


def main() -> None:
    from pyspark.sql import SparkSession

    from recoflux import queries, queries_more

    QUERIES = queries.QUERIES | queries_more.QUERIES

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = ["q_popularity_topk", "q_leave_last_n", "q_cold_start", "q_temporal_user", "q_global_temporal", "q_kfold", "q_user_item_matrix", "q_pop_norm", "q_tfidf", "q_numeric_scale", "q_similarity_topk", "q_metrics", "q_novelty", "q_eval_popularity", "q_project_metadata"]
    times = {}
    for name in names:
        runs = []
        for _ in range(4):  # the first one warms up; of the others the median counts
            began = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(sorted(runs[1:])[1], 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": d.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
