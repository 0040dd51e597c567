"""Bench: headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR.

Each query is run once to warm up, then timed three times with a ``noop``
write (the full plan runs, nothing is collected); the median is reported.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_rank_quoted", "t10_target_sections", "p4_ranking_gate", "c1_recursive_chunks",
    "revise_documents", "h3_render_lines", "h6_html_to_text", "h9_align_lines",
    "r9_reassemble", "j6_job_metrics", "j7_idle_gaps", "st3_idle_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    os.environ.setdefault("DOCREVISE_MASTER", f"local[{cpus}]")
    from docrevise.session import get_spark
    from docrevise.plans import catalog

    spark = get_spark(partitions=int(os.environ.get("BENCH_PARTITIONS", cpus)))
    times, errors = {}, {}
    for name in names:
        q = catalog.REGISTRY[name]
        try:
            q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            t = []
            for _ in range(runs):
                t0 = time.perf_counter()
                q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
                t.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(t), 3)
        except Exception as e:  # keep benching the rest
            errors[name] = repr(e)[:300]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "sum_median_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
