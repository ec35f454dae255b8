"""Headline benchmark: prints ONE JSON line.

    BENCH_SF_DIR   input tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local[N] (default 8)
    BENCH_REPEAT   timed runs per query, median reported (default 3; the
                   20x replicated profile runs once)
    BENCH_QUERIES  comma-separated subset (default: all headline queries)

Each query is executed end to end into the ``noop`` sink (every row is
computed, nothing is collected to the driver) after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tuneframe.operators import normalize as N  # noqa: E402
from tuneframe.operators import profile as P  # noqa: E402
from tuneframe.plans import fixtures as X  # noqa: E402
from tuneframe.plans.queries import REGISTRY  # noqa: E402
from tuneframe.plans.fixtures import SCAN_PARTITIONS  # noqa: E402
from tuneframe.session import builder  # noqa: E402

HEADLINE = [
    "validation_report",
    "validation_report_turns",
    "profile",
    "repair_summary",
    "dedupe",
    "detect_format",
    "normalize_mixed",
    "entropy",
    "doc_dup_ratio",
    "token_analysis",
    "train_eval_split",
    "encode_rows",
    "latest_state",
    "run_status",
    "grad_anomaly",
    "best_checkpoint",
    "list_datasets",
    "vram_matrix",
    "telemetry_rollup",
]


def profile_replicated(spark, sf, copies: int = 20):
    """T10 over ``documents`` replicated ``copies`` times (ids shifted per copy)."""
    recs = X.documents_as_records(spark, sf)
    big = recs.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    big = big.withColumn("idx", F.col("idx") + F.col("_copy") * 10_000_000).drop("_copy")
    return P.profile(N.to_messages(big)).drop("role_counts", "token_histogram", "turn_histogram")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = builder(master=f"local[{cpus}]", shuffle_partitions=2 * cpus).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # The tables are files of one row group each: deal their rows to all cores.
    spark.conf.set(SCAN_PARTITIONS, str(cpus))

    queries = {n: REGISTRY[n] for n in names if n in REGISTRY}
    if not chosen:
        queries["profile_docs_x20"] = profile_replicated

    def run(fn):
        t0 = time.perf_counter()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # Warm-up: JVM, codegen caches, Python workers.
    run(REGISTRY["validation_report"])
    times = {}
    for name, fn in queries.items():
        # The replicated profile is a throughput probe: one run is enough.
        n = 1 if name == "profile_docs_x20" else repeat
        runs = [run(fn) for _ in range(n)]
        times[name] = round(statistics.median(runs), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    out = {
        "metric": "total_median_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf_name) if sf_name.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
    }
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
