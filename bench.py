"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores,
BENCH_RUNS the repetitions (the best one counts). Results go to the noop sink,
so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "epss_status_by_source",
    "epss_asof_30d",
    "enriched_observations",
    "cve_counts",
    "clean_unified",
    "clean_reddit",
    "unify_sources",
    "source_stats",
    "merge_dedup",
    "update_cleaned_posts",
    "score_quartiles",
    "pr_auc",
    "pr_auc_price",
    "batch_loss_weighted",
    "foil_batches",
    "split_rows",
    "assemble_features",
    "ablation_grid",
    "token_windows",
    "top_thread",
    "article_extract",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from cvebeacon.plans.catalog import QUERIES
    from cvebeacon.session import SESSION_DEFAULTS

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    settings = {
        **SESSION_DEFAULTS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    times = {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
                "best_of": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
