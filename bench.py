"""Benchmark: wall time of the headline flows at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each flow is run once to warm up, then three times; the median
is reported. Results are written to Spark's no-op sink so the whole plan executes without
collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linecraft import catalog  # noqa: E402
from linecraft.session import get_session  # noqa: E402

# flow name -> registered query
FLOWS = {
    "f_corpus": "corpus_sentences",
    "f_chunks": "corpus_chunks",
    "f_plan": "render_plan",
    "f_score": "score_by_lang",
    "f_dataset": "dataset_split",
    "f_boxes": "layout_boxes",
}


def run(spark, name, sf):
    t0 = time.time()
    catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    out = {}
    for flow, name in FLOWS.items():
        if name not in catalog.QUERIES:
            continue
        run(spark, name, sf)
        out[flow] = round(statistics.median(run(spark, name, sf) for _ in range(reps)), 3)
    total = round(sum(out.values()), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "flows_total_wall", "value": total, "unit": "sec",
                      "queries": out, "sf": sf_name}))


if __name__ == "__main__":
    main()
