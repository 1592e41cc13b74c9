"""Command line: ``python -m gridloom names|extract ...``; run it under spark-submit on a cluster."""

from __future__ import annotations

import argparse
import sys

from .plans.features import FeaturePlan
from .plans.presets import SETS, preset, rgb_preset


def _plan(args: argparse.Namespace) -> FeaturePlan:
    if args.preset:
        return rgb_preset(args.preset.removeprefix("rgb-")) if args.preset.startswith("rgb-") else preset(args.preset)
    return FeaturePlan(args.bands.split(","), args.features.split(",") if args.features else None)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("names", "print a plan's features"), ("extract", "write the vectors of a patch table")):
        c = commands.add_parser(name, help=text)
        which = c.add_mutually_exclusive_group(required=True)
        which.add_argument("--preset", help=f"{', '.join(SETS)}, rgb-moments or rgb-33")
        which.add_argument("--bands", help="band names, with commas")
        c.add_argument("--features", help="feature names, with commas (default: the standard list of the bands)")
        if name == "extract":
            c.add_argument("--zero", default="", help="bands set to zero")
            c.add_argument("source")
            c.add_argument("target")
    args = parser.parse_args(argv)
    plan = _plan(args)
    if args.command == "names":
        for k, n, f in plan.schema_rows():
            print(k, n, f, sep="\t")
        return 0
    from pyspark.sql import SparkSession

    from .operators.extract import extract
    from .sources.patches import read_patches

    spark = SparkSession.builder.appName("gridloom-extract").getOrCreate()
    extract(read_patches(spark, args.source), plan, tuple(filter(None, args.zero.split(",")))).write.mode("overwrite").parquet(args.target)
    return 0


if __name__ == "__main__":
    sys.exit(main())
