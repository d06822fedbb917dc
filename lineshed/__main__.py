"""python -m lineshed import FILES OUT | fit FILE | templates | query NAME SF_DIR"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lineshed import tools
from lineshed.session import ship
from lineshed.sources import instruments


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lineshed", description=__doc__)
    sub = p.add_subparsers(dest="task", required=True)
    a = sub.add_parser("import", help="instrument files to Parquet")
    a.add_argument("files")
    a.add_argument("out")
    a.add_argument("--integrate", action="store_true", help="sum the slices of a region")
    a.add_argument("--axis", choices=["BE", "KE"])
    a = sub.add_parser("fit", help="automatic fit of a file, as JSON")
    a.add_argument("file")
    a.add_argument("--background", default="shirley", choices=tools.backgrounds())
    sub.add_parser("templates", help="the declared peak systems, as JSON")
    a = sub.add_parser("query", help="the first rows of a registered query")
    a.add_argument("name")
    a.add_argument("sf_dir")
    args = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    if args.task == "import":
        instruments.ingest(instruments.read_spectra(spark, args.files), args.integrate, args.axis).write.mode("overwrite").parquet(args.out)
    elif args.task == "fit":
        print(tools.fit_file(spark, args.file, args.background))
    elif args.task == "templates":
        print(tools.list_templates(spark))
    else:
        from lineshed.plans.catalog import QUERIES

        QUERIES[args.name](spark, args.sf_dir).show(20, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
