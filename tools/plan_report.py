"""Print the physical-plan shape of every registered query.

For each query: shuffle exchanges (with their keys), joins by kind, Python
stages, cartesian products and the columns each parquet scan reads.  Run:

    python tools/plan_report.py [sf_dir] [names...]
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "exchange": r"Exchange hashpartitioning\(([^)]*)\)",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "python": r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
    "cartesian": r"CartesianProduct|BroadcastNestedLoopJoin",
    "scan": r"ReadSchema: (struct<[^>]*>)",
}


def report(spark, name: str, sf_dir: str) -> dict:
    from docrevise.plans.catalog import REGISTRY

    df = REGISTRY[name].build(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()  # run once so adaptive plans are final
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items() if k not in ("exchange", "scan")}
    keys = collections.Counter(re.sub(r"#\d+", "", k).split(", ")[0] for k in re.findall(PATTERNS["exchange"], plan))
    out["exchanges"] = dict(keys)
    out["scans"] = sorted(set(re.findall(PATTERNS["scan"], plan)))
    return out


def main() -> None:
    from docrevise.plans.catalog import REGISTRY
    from docrevise.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(REGISTRY)
    spark = get_spark()
    for n in names:
        print(n, report(spark, n, sf), flush=True)


if __name__ == "__main__":
    main()
