"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query result goes to the ``noop`` sink (full execution, no output
I/O); one warm-up run, then the median of ``$BENCH_RUNS`` timed runs; the
least and the most of them stand in ``spread``. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hydrosight.plans.job import build  # noqa: E402
from hydrosight.plans.queries import QUERIES  # noqa: E402
from hydrosight.session import build_session  # noqa: E402
from hydrosight.sources.testdata import testdata_sources  # noqa: E402

# summary = the job as far as the summary needs it; job_end_to_end also writes
# the panel and the counters, from the same parts
HEADLINE = ["candidate_screen", "season_stats", "sp_contacts", "day_reconcile", "weekly_panel",
            "summary"]


def _sf(sf_dir: str) -> float | str:
    tail = os.path.basename(os.path.normpath(sf_dir))
    try:
        return float(tail.removeprefix("sf"))
    except ValueError:
        return tail


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, extra={
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="hydrosight-bench-")})

    def timed(make) -> float:
        t0 = time.perf_counter()
        make()
        return time.perf_counter() - t0

    def run_query(name):
        return lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    def run_job():
        r = build(spark, testdata_sources(spark, sf_dir))
        for df in (r.summary, r.panel, r.diagnostics):
            df.write.format("noop").mode("overwrite").save()
        r.release()

    results, spread = {}, {}
    for name in names + ["job_end_to_end"]:
        fn = run_job if name == "job_end_to_end" else run_query(name)
        timed(fn)  # warm-up
        times = [timed(fn) for _ in range(runs)]
        results[name] = round(statistics.median(times), 3)
        spread[name] = [round(min(times), 3), round(max(times), 3)]
    print(json.dumps({
        "metric": "median_query_sec_total",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "spread": spread,
        "sf": _sf(sf_dir),
        "config": {"cpus": cpus, "runs": runs,
                   "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                   "spark": spark.version},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
