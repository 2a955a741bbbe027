"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "ct_compile", "ct_detect_dimensions", "ct_validate_plan", "ct_dependency_evidence", "lk_rank_topk", "lk_catalog_scale", "lk_vector_topk", "jn_alias_theta",
    "jn_star_metric", "mx_plan_group", "mx_grouping_sets", "mx_simple_agg", "mx_surrogate_key", "ag_score_modes", "ag_round_state", "ag_latency_percentiles",
    "st_mcnemar_exact", "st_cluster_bootstrap", "cu_desensitize", "cu_conflict_withhold", "cu_stratified_sample", "dc_judge", "rc_column_match",
]


def main():
    from plumbline import queries
    from plumbline.session import local_session

    queries.load()
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.plumbline.deal", CPUS)  # its tables are single files with one row group
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.time()
            queries.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    rows = spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": FOLDER.rsplit("sf", 1)[-1],
        "decisions_per_sec": round(rows / times["ct_compile"]), "link_requests_per_sec": round(rows / times["lk_rank_topk"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
