"""Command line: ``python -m waymark list`` and ``python -m waymark run NAME --data DIR [--out DIR]``."""

from __future__ import annotations

import argparse
import sys
from importlib import import_module
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    """The arguments of the command line."""
    p = argparse.ArgumentParser(prog="waymark", description="Run a registered query over a folder of tables.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names and first lines of all queries")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder of the parquet tables")
    run.add_argument("--out", help="folder to write parquet to; without it the first rows are shown")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    queries = import_module("__spark_entry__").queries()
    if args.command == "list":
        for name, f in queries.items():
            print(name, "-", (f.__doc__ or "").strip().splitlines()[0] if f.__doc__ else "")
        return 0
    if args.name not in queries:
        print(f"no query {args.name}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    result = queries[args.name](SparkSession.builder.appName(f"waymark {args.name}").getOrCreate(), args.data)
    if args.out:
        result.write.mode("errorifexists").parquet(args.out)
    else:
        result.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
