"""List plan shapes that need a reason: cross joins, nested-loop joins, one-partition windows, Python stages.

usage: python tools/plans.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.session import local_session  # noqa: E402
from plumbline.suite import registry  # noqa: E402

SHAPES = {
    "cartesian product": r"CartesianProduct",
    "nested-loop join": r"BroadcastNestedLoopJoin",
    "python stage": r"(ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)",
    "window over one partition": r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition",
}


def main() -> None:
    sf, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.001"), tuple(sys.argv[2:])
    spark = local_session(8, "plans")
    for name, run in registry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        plan = run(spark, f"/root/testdata/sf{sf}")._jdf.queryExecution().executedPlan().toString()
        found = [f"{shape} x{len(re.findall(p, plan))}" for shape, p in SHAPES.items() if re.search(p, plan)]
        limit = " [top-n before shuffle]" if "WindowGroupLimit" in plan else ""
        if found or limit:
            print(f"{name:45s} {', '.join(found)}{limit}", flush=True)
    print("done")


if __name__ == "__main__":
    main()
