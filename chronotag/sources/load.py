"""Loads of points within limits, from Parquet or line protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotag.sources.files import LoadConfig, consecutive, file_time_bounds, footers, input_kind, list_files
from chronotag.sources.lineprotocol import parse_lines
from chronotag.sources.points import extract_points, limit_rows, max_cardinality, read_parquet, sort_by_time


def parquet_files(spark: SparkSession, config: LoadConfig, time: str | None = None) -> list[str]:
    """The files that a load reads: the first consecutive ones, told by their
    footers, up to the one that reaches the duration; all, if no footer has times."""
    found = footers(spark, config.path, time)
    if not found:
        raise FileNotFoundError(f"no Parquet files in {config.path}")
    chosen = consecutive(found, max_ns=config.max_duration_ns)
    return [f.file for f in chosen or found]


def _limited(points: DataFrame, config: LoadConfig) -> DataFrame:
    """Only the first tag sets, and of their points the first rows, by time."""
    if config.max_cardinality is not None:
        points = max_cardinality(points, config.max_cardinality, "ts_ns", "tags")
    return limit_rows(points, config.max_rows, "ts_ns", "tags") if config.max_rows is not None else points


def load_parquet(spark: SparkSession, config: LoadConfig, time: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """(ts_ns, tags) of a Parquet file or folder, within the limits."""
    df = read_parquet(spark, *parquet_files(spark, config, time), skip_corrupt=True)
    return _limited(extract_points(df, time, tags), config)


def load_lines(spark: SparkSession, config: LoadConfig) -> DataFrame:
    """(ts_ns, tags) of line protocol in order of time, within the limits; files
    are read in order of name up to the one that reaches the duration."""
    names = [n for n in list_files(spark, config.path) if n.endswith((".lp", ".txt"))]
    if not names:
        raise FileNotFoundError(f"no line protocol in {config.path}")
    lines = spark.read.text(names)
    if config.max_duration_ns is not None:
        own = parse_lines(lines.select("value", F.col("_metadata.file_path").alias("file")), keep=("file",))
        bounds = {r.file: r for r in file_time_bounds(own).collect()}  # a row for each file
        chosen, lo, hi = [], None, None
        for name in names:
            if lo is not None and hi - lo >= config.max_duration_ns:
                break
            chosen.append(name)
            r = next((b for f, b in bounds.items() if f.rpartition("/")[2] == name.rpartition("/")[2]), None)
            if r:
                lo, hi = min(x for x in (lo, r.min_ns) if x is not None), max(x for x in (hi, r.max_ns) if x is not None)
        lines = spark.read.text(chosen)
    return sort_by_time(_limited(parse_lines(lines), config), "ts_ns", "tags")


def load(spark: SparkSession, config: LoadConfig, time: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """(ts_ns, tags) of what ``config`` names, by its kind; a stream of it with
    ``as_stream``, which has no limits but the files of a trigger."""
    if not config.path:
        raise ValueError("no path to load")
    kind = config.kind or input_kind(config.path, list_files(spark, config.path))
    if config.as_stream:
        from chronotag.streaming.builds import read_stream

        return extract_points(read_stream(spark, config.path, config.files_per_trigger), time, tags)
    return load_lines(spark, config) if kind == "lineprotocol" else load_parquet(spark, config, time, tags)


def load_rows(spark: SparkSession, config: LoadConfig, time: str) -> DataFrame:
    """The first ``max_rows`` rows by time, all columns; other limits do not apply."""
    df = read_parquet(spark, *(f.file for f in footers(spark, config.path, time)), skip_corrupt=True)
    return df if config.max_rows is None else limit_rows(df, config.max_rows, time, *(c for c in df.columns if c != time))
