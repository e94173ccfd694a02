"""Point and range queries, one at a time or in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.functions.timeutil import bucket, ceil_ns, floor_ns, raw_range


def in_range(df: DataFrame, lo: int, hi: int, resolution_ns: int = 1, ts: str = "ts_ns") -> DataFrame:
    """Rows of the buckets that [lo, hi) touches.

    The bounds are widened on the driver, so the filter is on the raw column
    and reaches the scan.
    """
    return df.where(raw_range(F.col(ts), df.schema[ts].dataType, floor_ns(lo, resolution_ns), ceil_ns(hi, resolution_ns)))


def query_range(points: DataFrame, lo: int, hi: int, resolution_ns: int = 1) -> DataFrame:
    """The distinct tag sets of [lo, hi)."""
    return in_range(points, lo, hi, resolution_ns).select("tags").distinct()


def query_point(points: DataFrame, t: int, resolution_ns: int = 1, bag: bool = False) -> DataFrame:
    """The tag sets of t's bucket; ``bag`` keeps one row for each point."""
    lo = floor_ns(t, resolution_ns)
    found = in_range(points, lo, lo + max(1, resolution_ns)).select("tags")
    return found if bag else found.distinct()


def query_intervals(intervals: DataFrame, lo: int, hi: int) -> DataFrame:
    """The distinct tag sets of intervals that overlap [lo, hi)."""
    return intervals.where((F.col("start_ns") < hi) & (F.col("stop_ns") > lo)).select("tags").distinct()


def query_intervals_point(intervals: DataFrame, t: int) -> DataFrame:
    return query_intervals(intervals, t, t + 1)


def bounds(postings: DataFrame, resolution_ns: int) -> DataFrame:
    """First bucket, and last bucket plus the resolution."""
    return postings.agg(F.min("bucket_ns").alias("min_ns"), (F.max("bucket_ns") + max(1, resolution_ns)).alias("max_ns"))


def query_points_batch(postings: DataFrame, probes: DataFrame, resolution_ns: int) -> DataFrame:
    """(probe_id, tags) for probes (probe_id, t): one equi-join on the bucket."""
    at = probes.select("probe_id", bucket(F.col("t"), resolution_ns).alias("bucket_ns"))
    return at.join(postings, "bucket_ns").select("probe_id", "tags").distinct()


#: A wide range is met as whole cells; a cell holds this many buckets.
CELL_BUCKETS = 64


def query_ranges_batch(postings: DataFrame, probes: DataFrame, resolution_ns: int, cell_buckets: int = CELL_BUCKETS) -> DataFrame:
    """(probe_id, tags) for probes (probe_id, lo, hi).

    Buckets are first reduced to cells of many, so a range meets the cells that
    it covers whole through their distinct tag sets, and only the cells at its
    ends bucket by bucket.
    """
    res = max(1, resolution_ns)
    cell = res * cell_buckets
    up = lambda c, by: c + F.pmod(-c, F.lit(by))
    wide = probes.select("probe_id", bucket(F.col("lo"), resolution_ns).alias("lo"), (up(F.col("hi"), res) if res > 1 else F.col("hi")).alias("hi")).where(F.col("lo") < F.col("hi"))
    wide = wide.withColumn("c0", F.least(up(F.col("lo"), cell), F.col("hi"))).withColumn("c1", F.greatest(F.col("hi") - F.pmod("hi", F.lit(cell)), F.col("c0")))
    steps = lambda a, b, by: F.when(a < b, F.sequence(a, b - by, F.lit(by)))
    ends = wide.select("probe_id", F.explode(F.concat(F.coalesce(steps(F.col("lo"), F.col("c0"), res), F.array().cast("array<bigint>")), F.coalesce(steps(F.col("c1"), F.col("hi"), res), F.array().cast("array<bigint>")))).alias("bucket_ns"))
    inner = wide.select("probe_id", F.explode(steps(F.col("c0"), F.col("c1"), cell)).alias("cell_ns"))
    cells = postings.select(bucket(F.col("bucket_ns"), cell).alias("cell_ns"), "tags").distinct()
    return ends.join(postings, "bucket_ns").select("probe_id", "tags").union(inner.join(cells, "cell_ns").select("probe_id", "tags")).distinct()


