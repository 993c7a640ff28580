"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

#: Tiles and grids stand for the reference's timed paths; the rest are its costlier joins, runs and array transforms.
HEADLINE = ("tile_max_hold", "tile_gap_fill", "frame_meta", "sample_rate", "gap_sessions", "resample_uniform", "hybrid_cascade", "range_series", "reference_pool", "dft_power", "logistic_score")


def main() -> None:
    from wavemill.plans import catalog
    from wavemill.session import local_session

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            found[name](spark, root).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(root.rstrip("/"))}))


if __name__ == "__main__":
    main()
