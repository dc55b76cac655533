"""Write condensed physical plans of the registered queries to PLANS.md.

    BENCH_SF_DIR=/root/testdata/sf0.1 python tools/plans.py

Only the nodes that matter for scale are kept: exchanges (shuffles and
broadcasts), joins, aggregates, windows, Python stages and scans with their
pushed filters and read schema.  Queries that write files (sinks, streams)
are skipped: planning them would run their writes.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = ("Exchange", "Join", "Aggregate", "Window", "MapInPandas", "ArrowEvalPython", "FileScan",
        "TakeOrderedAndProject", "Expand", "Generate", "Union", "Sort ")
SKIP = {"sink_roundtrip", "text_folder", "chunk_store", "call_log_roundtrip", "stream_chunks", "stream_cost",
        "guarded_sql", "guarded_preview", "guarded_status"}
LINES = 40  # of a query; the rest is counted


def condense(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        if any(k in line for k in KEEP):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/", "file: ", line)
            line = re.sub(r", \[plan_id=\d+\]", "", line)
            if "FileScan" in line:
                m = re.search(r"FileScan parquet \[[^\]]*\].*?(PushedFilters: \[[^\]]*\]).*?(ReadSchema: \S+)", line)
                head = line[: line.index("FileScan")] + "FileScan parquet"
                line = f"{head} {m.group(1)} {m.group(2)}" if m else line
            out.append(line.rstrip()[:150])
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from tessera.plans import registry
    from tessera.session import build_session

    spark = build_session("local[8]", shuffle_partitions=16)
    lines = ["# Physical plans (condensed)", "",
             f"Generated by `tools/plans.py` at `{sf}` on local[8]; AQE may still re-plan at run time",
             "(broadcasts from size statistics, coalesced partitions).", ""]
    for name, fn in registry.queries().items():
        if name in SKIP:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        kept = condense(plan)
        more = [f"... {len(kept) - LINES} more"] if len(kept) > LINES else []
        lines += [f"## {name}", "", "```", *kept[:LINES], *more, "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    print(path)


if __name__ == "__main__":
    main()
