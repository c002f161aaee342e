"""Write PLANS.md: the physical plan outline of the headline queries.

For each query: the operator tree of ``explain("formatted")`` and, for every
Parquet scan, its partition filters, pushed filters and read schema width —
the evidence that filters reach the scan and projections are pruned.
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tillpoint.plans.catalog import load_all  # noqa: E402
from tillpoint.session import build_session  # noqa: E402

QUERIES = ["p01_channel_date_pivot", "p11_heatmap_cells", "d04_discount_by_brand", "d03_customer_table",
           "g13_rfm", "p04_general_pivot_sum", "e01_customer_totals_on_orders", "b04_membership_filter"]


def outline(text: str) -> str:
    tree = text.split("\n\n\n")[0]
    scans = []
    for block in text.split("\n\n"):
        if re.match(r"\(\d+\) Scan parquet", block.strip()):
            keep = [ln for ln in block.strip().splitlines()
                    if ln.startswith(("(", "PartitionFilters", "PushedFilters"))]
            rs = re.search(r"ReadSchema: struct<(.*)>", block)
            if rs:
                keep.append(f"ReadSchema: {rs.group(1).count(':')} columns")
            scans.append("\n".join(keep))
    return tree + "\n\n" + "\n\n".join(scans)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8, app="tillpoint-explain")
    reg = load_all()
    out = ["# Physical plans of headline queries", "",
           f"Generated by `tools/explain.py` on `{os.path.basename(sf)}`, local[8], AQE on "
           "(initial plans; AQE may still switch a sort-merge join to broadcast at run time).", ""]
    for name in QUERIES:
        df = reg[name].build(spark, sf)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        out += [f"## {name}", "", "```", outline(buf.getvalue()).strip(), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w", encoding="utf-8") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
