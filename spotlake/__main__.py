"""``python -m spotlake analyze IMAGE... --diameter-mm D --out FOLDER``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from spotlake.operators.pipeline import analyse_files, write_results


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spotlake")
    analyze = parser.add_subparsers(dest="command", required=True).add_parser("analyze", help="candidates and densities of wafer images")
    analyze.add_argument("images", nargs="+")
    analyze.add_argument("--diameter-mm", type=float, required=True)
    analyze.add_argument("--out", required=True)
    analyze.add_argument("--tile", type=int, default=1024)
    analyze.add_argument("--halo", type=int, default=128)
    analyze.add_argument("--edge-px", type=float, default=8.0)
    analyze.add_argument("--background", type=int, default=101)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("spotlake").getOrCreate()
    results = analyse_files(spark, given.images, given.diameter_mm, given.tile, given.halo, edge_px=given.edge_px, background=given.background)
    write_results(results, given.out)
    return int(results["summaries"].where("status = 'failed'").limit(1).count())


if __name__ == "__main__":
    raise SystemExit(main())
