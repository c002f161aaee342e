"""Command line: list registered queries, or run one.

    python -m tillpoint list
    python -m tillpoint run p01_channel_date_pivot /root/testdata/sf0.01 [--out DIR] [--master local[8]]

``--out`` writes the result as header CSV files (distributed write);
otherwise the first rows are shown.
"""

from __future__ import annotations

import argparse

from tillpoint.plans.catalog import load_all


def main() -> None:
    ap = argparse.ArgumentParser(prog="tillpoint")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    run.add_argument("--master", default=None)
    run.add_argument("--rows", type=int, default=20)
    args = ap.parse_args()
    reg = load_all()
    if args.cmd == "list":
        for name, q in sorted(reg.items()):
            print(f"{name}\t{','.join(q.ids)}\t{'sql' if q.sql else 'rows'}")
        return
    from tillpoint.session import build_session
    from tillpoint.sources.sink import export_csv
    spark = build_session(args.master)
    df = reg[args.name].build(spark, args.sf_dir)
    if args.out:
        export_csv(df, args.out)
    else:
        df.show(args.rows, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
