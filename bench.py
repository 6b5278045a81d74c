"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from taxaloom.plans.queries import QUERIES
from taxaloom.session import local_session

HEADLINE = ("q_tax_counts", "q_bins", "q_lineage", "q_canonical", "q_candidates", "q_bin_features", "q_select_best", "q_refined_calls", "q_network_scores", "q_isotonic", "q_auroc", "q_best_f1", "q_batches")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 2)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
