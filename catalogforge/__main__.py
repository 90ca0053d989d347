"""Command line: ``python -m catalogforge compile|build|listings|extract IN OUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from catalogforge.plans import catalog, compile


def main() -> None:
    parser = argparse.ArgumentParser(prog="catalogforge")
    parser.add_argument("job", choices=["compile", "build", "listings", "extract"])
    parser.add_argument("source", help="folder of exports, compiled table, or catalogue")
    parser.add_argument("out")
    parser.add_argument("--layout", choices=["positional", "by_width"], default="positional")
    parser.add_argument("--csv", action="store_true", help="also write the compiled table as CSV")
    parser.add_argument("--skip-unreadable", action="store_true")
    parser.add_argument("--list-duplicates", action="store_true")
    parser.add_argument("--max-year", type=int)
    args = parser.parse_args()

    spark = SparkSession.builder.appName(f"catalogforge-{args.job}").getOrCreate()
    if args.job == "compile":
        compile.compile_exports(
            spark,
            args.source,
            args.out,
            layout=args.layout,
            csv=args.csv,
            skip_unreadable=args.skip_unreadable,
            list_duplicates=args.list_duplicates,
        )
    elif args.job == "build":
        compiled = spark.read.parquet(args.source)
        catalog.build_catalogue(spark, compiled, args.out, max_year=args.max_year)
    elif args.job == "listings":
        catalog.build_listings(spark, args.source, args.out)
    else:
        catalog.extract_entities(spark.read.parquet(args.source), args.out)


if __name__ == "__main__":
    main()
