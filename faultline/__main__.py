"""Command line: ``python -m faultline list`` and ``python -m faultline run QUERY --data FOLDER [--out FOLDER] [--sql]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import catalog


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="faultline", description="Change-point analytics on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("query", choices=sorted(catalog.queries()))
    run.add_argument("--data", required=True, help="folder of the Parquet tables")
    run.add_argument("--out", help="folder to write the result to, as Parquet; printed otherwise")
    run.add_argument("--rows", type=int, default=20, help="rows to print")
    run.add_argument("--sql", action="store_true", help="print the query's SQL instead")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalog.queries())))
    elif given.sql:
        print(catalog.oracles().get(given.query, "no SQL"))
    else:
        result = catalog.queries()[given.query](SparkSession.builder.getOrCreate(), given.data)
        if given.out:
            result.write.parquet(given.out)
        else:
            result.show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
