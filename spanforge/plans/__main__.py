"""``spark-submit -m spanforge.plans QUERY TABLES OUT``: run a query and write its result as Parquet."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from spanforge.plans.catalog import QUERIES


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in QUERIES:
        print(f"usage: QUERY TABLES OUT; queries: {', '.join(sorted(QUERIES))}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    QUERIES[args[0]](spark, args[1]).write.mode("overwrite").parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
