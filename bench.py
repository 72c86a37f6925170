"""Time the registered queries on local[$BENCH_CPUS] over $BENCH_SF_DIR.

Every query is written to Spark's no-op sink once to warm up, then three times;
its time is the median.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks.compare import local_session
from checks.queries import QUERIES


def timed(spark, sf_dir: str, key: str) -> float:
    start = time.perf_counter()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(keys: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for key in keys or QUERIES:
        timed(spark, sf_dir, key)
        times[key] = round(statistics.median(timed(spark, sf_dir, key) for _ in range(runs)), 4)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(sys.argv[1:])
