"""Time the headline queries and print one JSON line.

Each query is warmed up twice and then run three times into the ``noop`` sink; the median
counts. Queries that write include their writes.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from lakeweave.benchmark_queries import QUERIES
from lakeweave.operators import distinct_rows, rank_readings
from lakeweave.session import CHECKPOINT_DIR, cluster_conf, local_session
from lakeweave.sources import star_views as star
from lakeweave.sources.tables import partition_predicate

WARM_UPS, RUNS = 2, 3


def dedup_and_rank_in_memory(spark, sf_dir):
    readings = star.sensor_readings(spark, sf_dir)
    return rank_readings(distinct_rows(readings.unionAll(readings)))


def replicate_partitions_in_memory(spark, sf_dir):
    chosen = partition_predicate(("event_date", "region"), {"region": ["ASIA"]})
    return star.raw_events(spark, sf_dir).where(chosen).groupBy("event_type").count()


HEADLINE = {
    name: QUERIES[name]
    for name in (
        "regional_summary",
        "product_revenue",
        "customer_ltv",
        "event_funnel",
        "customer_ltv_top5",
        "sensor_ranking",
        "dedup_distinct",
    )
} | {
    "dedup_and_rank_in_memory": dedup_and_rank_in_memory,
    "replicate_partitions_in_memory": replicate_partitions_in_memory,
} | {
    name: QUERIES[name]
    for name in (
        "dedup_and_rank",
        "partitioned_roundtrip",
        "replicate_partitions",
        "load_reconciliation",
        "directory_publish",
        "federated_inventory",
        "orphan_keys",
        "duplicate_keys",
    )
}


def seconds(spark, query, sf_dir) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def forget_databases(spark) -> None:
    """Drop the databases that a query's writes registered."""
    for database in spark.catalog.listDatabases("lakeweave_*"):
        spark.sql(f"DROP NAMESPACE IF EXISTS `{database.name}` CASCADE")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    # Partitions and adaptive settings as on a cluster of this size, for the bytes of the tables.
    conf = cluster_conf(0, int(cores) // 2) | {
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        CHECKPOINT_DIR: os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="bench-"),
        "spark.sql.files.maxPartitionBytes": "128MB",
    }
    spark = local_session(cores, "bench", conf)
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name, query in HEADLINE.items():
        for _ in range(WARM_UPS):
            seconds(spark, query, sf_dir)
        timings[name] = round(statistics.median(seconds(spark, query, sf_dir) for _ in range(RUNS)), 3)
        forget_databases(spark)
        print(f"{name}: {timings[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
