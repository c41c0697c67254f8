"""Time every query once warm: prints one JSON line.

``BENCH_SF_DIR`` picks the tables, ``BENCH_CPUS`` the threads, ``BENCH_QUERIES`` a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from tabprep.session import build_session
from workloads.queries import all_queries


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    queries = all_queries()
    names = chosen.split(",") if chosen else list(queries)
    queries["split_chrono"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
