"""Compact physical-plan report of registered queries: scans (pruned schema, pushed
filters), exchanges, broadcasts, windows, Python stages. Usage:
python tools/plan_report.py [sf_dir] [name ...] > PLANS.md
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linecraft import catalog  # noqa: E402
from linecraft.session import get_session  # noqa: E402

KINDS = {
    "exchanges (shuffles)": r"[-:] Exchange \(",
    "broadcast exchanges": r"BroadcastExchange \(",
    "sort-merge joins": r"SortMergeJoin",
    "broadcast hash joins": r"BroadcastHashJoin",
    "windows": r"[-:] Window \(",
    "python stages": r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas|BatchEvalPython",
}


def report(spark, name, sf):
    df = catalog.QUERIES[name](spark, sf)
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    plan = buf.getvalue()
    tree = plan.split("\n\n", 1)[0]
    scans = re.findall(r"Scan parquet[^\n]*\n(?:[^\n]*\n){0,12}?ReadSchema: ([^\n]*)", plan)
    pushed = re.findall(r"PushedFilters: (\[[^\n]*\])", plan)
    out = [f"### `{name}`", "", (catalog.QUERIES[name].__doc__ or "").strip().splitlines()[0], ""]
    out.append("| plan element | count |")
    out.append("|---|---|")
    for k, pat in KINDS.items():
        out.append(f"| {k} | {len(re.findall(pat, tree))} |")
    out.append("")
    for s, p in zip(scans, pushed + [""] * len(scans)):
        out.append(f"- scan reads `{s}`" + (f", pushed filters `{p}`" if p and p != "[]" else ""))
    out.append("")
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = get_session("local[8]", shuffle_partitions=16)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on {sf}: the physical plans as planned "
          "(adaptive execution may still turn joins into broadcast joins and coalesce or split "
          "partitions at run time).\n")
    for n in names:
        print(report(spark, n, sf))


if __name__ == "__main__":
    main()
