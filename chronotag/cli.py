"""Command line: ``python -m chronotag.cli <command>``."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotag.functions.timeutil import format_bytes, format_elapsed, nanos, parse_cardinality, parse_duration
from chronotag.operators import stats
from chronotag.plans.index import MODES, TagIndex
from chronotag.sources import files, generator, load, points


def count(spark: SparkSession, args: argparse.Namespace) -> None:
    found = files.footers(spark, args.path)
    for f in found:
        print(f"{f.file}: {f.rows} rows")
    print(f"total: {sum(f.rows for f in found)} rows in {len(found)} files")


def check_sorted(spark: SparkSession, args: argparse.Namespace) -> None:
    for f in files.footers(spark, args.path, args.time):
        df = spark.read.parquet(f.file)
        rows = df.select(F.monotonically_increasing_id().alias("at"), nanos(F.col(args.time), df.schema[args.time].dataType).alias("ts_ns"))
        # positions of a partition are consecutive from a multiple of 2**33 on
        r = files.check_sorted(rows, "at", groups=1 << 33).first()
        print(f"{f.file}: {r.rows or 0} rows, {r.first_ns} to {r.last_ns}, " + (f"{r.inversions} inversions" if r.inversions else "sorted"))


def sort(spark: SparkSession, args: argparse.Namespace) -> None:
    points.sort_by_time(spark.read.parquet(args.path), args.time).write.mode("overwrite").option("compression", "zstd").parquet(args.out)
    print(f"{spark.read.parquet(args.out).count()} rows in {args.out}")


def generate(spark: SparkSession, args: argparse.Namespace) -> None:
    made = generator.generate_points(spark, parse_cardinality(args.cardinality), args.points)
    generator.write_points(made, args.out)
    print(f"{spark.read.parquet(args.out).count()} rows in {args.out}")


def compare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Build all modes from the first rows, append the rows after them, ask all
    modes the same, and report whether they agree."""
    resolution = parse_duration(args.resolution) or 1
    config = files.LoadConfig(args.path, max_rows=(args.rows + args.append) if args.rows else None)
    rows = load.load(spark, config, args.time, args.tags.split(",") if args.tags else None).cache()
    first = points.limit_rows(rows, args.rows, "ts_ns", "tags") if args.rows else rows
    more = rows.exceptAll(first) if args.rows else rows.limit(0)
    lo, hi = rows.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    results: dict[str, list[DataFrame]] = {}
    for mode in MODES:
        began = time.perf_counter()
        index = TagIndex.build(first, resolution, mode)
        if args.append:
            index = index.append(more)
        intervals = index.interval_count()
        built = time.perf_counter() - began
        middle = (lo + hi) // 2
        results[mode] = [index.query_full_range(), index.query_range(lo, middle), index.query_point(middle)]
        began = time.perf_counter()
        found = [r.count() for r in results[mode]]
        print(f"{mode}: {intervals} intervals in {format_elapsed(built)}, {format_bytes(index.size_bytes())}; tag sets in all, first half, middle: {found} in {format_elapsed(time.perf_counter() - began)}")
    same = all(not stats.results_diff(a, b).limit(1).count() for mode in MODES[1:] for a, b in zip(results[MODES[0]], results[mode], strict=True))
    print("all modes agree" if same else "modes differ")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chronotag")
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("count", help="rows of each file, from footers")
    one.add_argument("path")
    one = commands.add_parser("check-sorted", help="inversions of time in each file")
    one.add_argument("path")
    one.add_argument("--time", default="time")
    one = commands.add_parser("sort", help="sort by time into another folder")
    one.add_argument("path")
    one.add_argument("out")
    one.add_argument("--time", default="time")
    one = commands.add_parser("generate", help="points of a number of tag sets (10K, 1.5M)")
    one.add_argument("cardinality")
    one.add_argument("out")
    one.add_argument("--points", type=int, default=generator.POINTS)
    one = commands.add_parser("compare", help="build, append, query and compare all modes")
    one.add_argument("path")
    one.add_argument("rows", type=int, nargs="?", default=0)
    one.add_argument("append", type=int, nargs="?", default=0)
    one.add_argument("--time")
    one.add_argument("--tags")
    one.add_argument("--resolution", default="1h")
    return out


COMMANDS = {"count": count, "check-sorted": check_sorted, "sort": sort, "generate": generate, "compare": compare}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command](spark or SparkSession.builder.appName("chronotag").getOrCreate(), args)


if __name__ == "__main__":
    main()
