"""Times the queries and prints one JSON line.

Each query is run to completion into a sink that discards the rows.  All are first run
once on the smallest tables, if those lie next to the given ones, so that the times do not
show the start of the JVM.  ``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the number
of local cores; arguments name queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearprint.plans import job_queries  # noqa: F401
from nearprint.plans import queries as plans
from nearprint.session import local_session

# Their work is that of another query here, and a join of small tables.
LEFT_OUT = {"annotated_pairs", "similar_groups", "job_normalise", "job_similar_articles", "job_recommendations"}


def similar_pairs_t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.document_pairs(spark, sf_dir, 0.8)


def run(query: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> float:
    begin = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = {name: query for name, query in plans.REGISTRY.items() if name not in LEFT_OUT} | {"similar_pairs_t08": similar_pairs_t08}
    if len(sys.argv) > 1:
        chosen = {name: chosen.get(name) or plans.REGISTRY[name] for name in sys.argv[1:]}
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for query in chosen.values():
            run(query, spark, small)
    times = {name: run(query, spark, sf_dir) for name, query in chosen.items()}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
