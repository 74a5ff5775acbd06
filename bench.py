"""Time the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and print one JSON line.

Each query is executed in full into Spark's ``noop`` sink (nothing is
collected to the driver); the time includes planning and any scalar
subqueries, stage tables and model fits the query needs.  Before timing, the
same queries run once untimed on ``$BENCH_WARMUP_DIR`` (default sf0.001; set it
empty to skip) so JVM/JIT warm-up is not charged to whichever query comes first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lineax.plans import registry  # noqa: E402
from lineax.session import local_session  # noqa: E402

HEADLINE = [
    "fitness_table",
    "lineage_growth",
    "build_haplotypes",
    "representative_table",
    "training_table",
    "escape_task_table",
    "fitness_task_table",
    "task_vectors",
    "dedupe_keep_first",
    "spearman",
    "evaluate_predictions",
    "read_fasta",
    "explode_mutation_lists",
    "stratified_folds",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="lineax-bench")
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm_dir:
        for name in names:  # untimed warm-up pass on a small scale
            registry.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = registry.S.scale_of(sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "warmup": warm_dir or None}))


if __name__ == "__main__":
    main()
