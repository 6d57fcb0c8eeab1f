"""Benchmark: wall time of every registered query.

Runs each ``queries()`` entry at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.

Every query is fully computed with the ``noop`` sink (all partitions, no
collect). Each query runs once as warm-up, then ``$BENCH_REPEAT`` times
(default 3); the median is recorded.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitrina.plans.registry import queries  # noqa: E402
from vitrina.session import local_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="vitrina-bench")
    qs = queries()
    if only:
        qs = {k: v for k, v in qs.items() if k in only}
    times: dict[str, float] = {}
    for key, fn in qs.items():
        run(fn(spark, sf_dir))  # warm-up: plan caches, codegen, JIT
        samples = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(fn(spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_wall_time_all_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "n_queries": len(times),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
