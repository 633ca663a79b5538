"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Python workers

from seqloom.plans import catalog  # noqa: E402
from seqloom.plans.pipeline import spark_session  # noqa: E402

HEADLINE = ["route_counts", "barcode_decode", "sample_metrics", "pairing", "dedup", "overrepresented", "fastq_stats", "filter_counts", "full_adapter", "cut_tail", "cycle_content", "mate_overlap", "pair_bounds", "sample_adapters"]
MOST_SECONDS = 120  # no query begins later than this


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = spark_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    queries["route_counts"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        if sum(times.values()) > MOST_SECONDS:
            break
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "read queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
