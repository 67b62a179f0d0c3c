"""Operator counts of every SQL-style job's plan, as a Markdown table (docs/SCALE.md).

    python scripts/plan_table.py [sf_dir]

Automatic broadcast and AQE are off, so that the plans are those of large tables.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, ".")
from basketry.plans import registry  # noqa: E402
from basketry.session import build_session  # noqa: E402


def main(sf_dir: str) -> None:
    spark = build_session("local[4]", app="basketry-plans")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    print("| job | exchanges | single-partition | joins | windows | group limits | scans |\n| --- | --- | --- | --- | --- | --- | --- |")
    for name, job in registry.queries().items():
        if name in registry.MODEL_JOBS:
            continue
        lines = [x.lstrip(" :+-*()0123456789") for x in job(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()]
        n = Counter(re.match(r"\w*", x)[0] for x in lines)
        joins = ", ".join(f"{k} {v}" for k, v in sorted(n.items()) if k.endswith("Join")) or "-"
        single = sum(x.startswith("Exchange SinglePartition") for x in lines)
        print(f"| `{name}` | {n['Exchange']} | {single} | {joins} | {n['Window']} | {n['WindowGroupLimit']} | {n['FileScan']} |", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
