"""Headline queries, timed on local cores; prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 4)."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tideframe.plans import catalogue  # noqa: E402
from tideframe.session import local_session, ship  # noqa: E402

HEADLINE = (
    "log_counts", "tpch_q1", "tpch_q6", "tpch_q6_1996", "positions_per_user", "latest_per_user", "distinct_partition_offset", "json_kind_counts", "top_n_latest",
    "scan_pushdown", "bucket_hour", "file_groups", "range_bucket_files", "column_stats", "aborted_filtered", "as_of_snapshot", "view_merged", "snapshot_totals", "tier_sorted_write",
)


def pruning(spark, sf_dir: str) -> dict[str, str]:
    """Files that the engine would read of all files of lineitem, for predicates of the published shapes."""
    from datetime import datetime

    from tideframe.operators.pruning import Domain
    from tideframe.plans import tables

    engine = tables._made(spark, sf_dir, tables._typed)
    files = engine.files("lineitem")
    total = files.count()
    between = lambda a, b: Domain(((datetime(*a), datetime(*b), True, False),))
    shapes = {
        "l_shipdate in January 1996": {"l_shipdate": between((1996, 1, 1), (1996, 2, 1))},
        "l_shipdate in 1996": {"l_shipdate": between((1996, 1, 1), (1997, 1, 1))},
        "partition = 1": {"_kafka_partition": Domain(values=(1,))},
    }
    return {name: f"{engine.matching('lineitem', files, domains).count()} of {total}" for name, domains in shapes.items()}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, spark__driver__memory="6g", spark__sql__warehouse__dir="/tmp/tideframe_bench")
    ship(spark)
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "files_read": pruning(spark, sf_dir), "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
