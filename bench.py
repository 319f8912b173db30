"""Wall time of every catalogue query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once, in full, into a sink that discards the rows; one untimed run of a
query with a Python step warms up the JVM and the Python workers.  Prints one JSON line.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scanweave.plans.catalogue import QUERIES
from scanweave.session import local_session


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "scanweave-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("state_match")
    times = {}
    for name in only:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "catalogue_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
