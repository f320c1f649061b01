"""Command line: ``python -m quarrylog.cli INPUT... [--out STEM] [--keyword] [--database FILE]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.scan import Options, run


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarrylog")
    p.add_argument("inputs", nargs="+", help="directories, log files or archives")
    p.add_argument("--out", dest="stem", help="path without ending for the written files")
    p.add_argument("--keyword", action="store_true", help="any line with a severity keyword")
    p.add_argument("--database", help="cumulative CSV to append to")
    p.add_argument("--no-detail", dest="detail", action="store_false")
    p.add_argument("--no-summary", dest="summary", action="store_false")
    p.add_argument("--no-statistics", dest="statistics", action="store_false")
    p.add_argument("--no-category", dest="category", action="store_false")
    p.add_argument("--per-input", action="store_true", help="keyword duplicates are told apart by input")
    p.add_argument("--anonymise", action="store_true", help="addresses, servers and shares become numbered names")
    p.add_argument("--distributed", action="store_true", help="detail rows as a folder of part files, written by executors")
    p.add_argument("--quiet", action="store_true", help="no messages while it runs")
    arguments = vars(p.parse_args(argv))
    quiet = arguments.pop("quiet")
    spark = SparkSession.builder.appName("quarrylog").getOrCreate()
    result = run(spark, Options(**arguments, progress=None if quiet else print))
    for name, value in {**result.counts, **result.files}.items():
        print(f"{name}: {value}")
    for e in result.errors.toLocalIterator():
        print(f"not read: {e.source_name}: {e.error}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
