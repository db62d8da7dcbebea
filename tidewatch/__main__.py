"""Command line: ``python -m tidewatch list``, ``run NAME``, ``sql TEXT``, each over a folder of Parquet tables."""

import argparse

from .plans import registry
from .session import local_session
from .sources.io import register_views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewatch", description=__doc__)
    parser.add_argument("command", choices=["list", "run", "sql"])
    parser.add_argument("what", nargs="?", help="a query's name, or SQL text over the tables' names")
    parser.add_argument("--data", help="the folder of <table>.parquet")
    parser.add_argument("--out", help="a folder for the result as Parquet; without it, rows are shown")
    parser.add_argument("--rows", type=int, default=20)
    a = parser.parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    if not a.what or not a.data:
        parser.error("give a query and --data")
    spark = local_session()
    if a.command == "sql":
        register_views(spark, a.data, TABLES)
        df = spark.sql(a.what)
    else:
        df = registry.QUERIES[a.what](spark, a.data)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
