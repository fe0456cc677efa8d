"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from tessera.plans.registry import QUERIES  # noqa: E402
from tessera.session import session  # noqa: E402

HEADLINE = ["cabs_fm_select", "cabs_dm_select", "concept_frequency", "cabs_dm_targets", "box_overlap_filter", "box_nms", "box_wbf", "retrieval_recall", "space_caption", "class_in_caption_vanilla", "mean_ap", "softmax_pool"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        found[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
