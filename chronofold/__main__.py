"""python -m chronofold index|stats|doctor REPOSITORY --store PATH"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from chronofold.plans.index import index_repository, report_json, stats_report
from chronofold.sources.store import Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronofold", description="History analytics of a repository")
    parser.add_argument("command", choices=["index", "stats", "doctor"])
    parser.add_argument("repository")
    parser.add_argument("--store", required=True, help="where the index is kept")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    store = Store(spark, args.store)
    if args.command == "index" or store.meta().get("index_state") != "ready":
        store = index_repository(spark, args.repository, args.store)
    if args.command == "doctor":
        problems = store.integrity()
        print("\n".join(problems) or "sound")
        return 1 if problems else 0
    if args.command == "stats":
        print(report_json(stats_report(store)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
