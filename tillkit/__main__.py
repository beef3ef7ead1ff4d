"""Command line: list the registered plans, or run one and write its result.

    python -m tillkit list
    python -m tillkit run R2_daily_sales --data /path/to/tables --out /path/out [--format json]
    python -m tillkit sql R2_daily_sales        # print the plan's oracle SQL
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tillkit")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered plans")
    run = sub.add_parser("run", help="run a plan and write its result")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder of the input parquet tables")
    run.add_argument("--out", required=True, help="output folder")
    run.add_argument("--format", default="parquet", choices=["parquet", "json"])
    run.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    show = sub.add_parser("sql", help="print a plan's oracle SQL")
    show.add_argument("name")
    args = parser.parse_args(argv)

    from tillkit.plans.catalog import PLANS

    if args.cmd == "list":
        for name in sorted(PLANS):
            print(name)
        return 0
    if args.cmd == "sql":
        from tillkit.plans.sql import SQL

        print(SQL[args.name])
        return 0

    from tillkit.session import get_spark

    spark = get_spark(args.master)
    df = PLANS[args.name](spark, args.data)
    df.write.mode("overwrite").format(args.format).save(args.out)
    print(f"{args.name}: wrote {args.out} ({args.format})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
