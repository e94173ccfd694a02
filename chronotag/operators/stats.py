"""Counts and comparisons of indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.functions.timeutil import bucket
from chronotag.operators import build


def cardinality(points: DataFrame) -> DataFrame:
    return points.agg(F.countDistinct("tags").alias("tagsets"))


def bucket_span(points: DataFrame, resolution_ns: int) -> DataFrame:
    """Buckets between the first and the last point, occupied or not."""
    return points.agg(F.ceil((F.max("ts_ns") - F.min("ts_ns")) / resolution_ns).cast("long").alias("buckets"))


def load_stats(points: DataFrame) -> DataFrame:
    return points.agg(
        F.count("*").alias("rows"),
        F.countDistinct("tags").alias("tagsets"),
        F.min("ts_ns").alias("min_ns"),
        F.max("ts_ns").alias("max_ns"),
        (F.max("ts_ns") - F.min("ts_ns")).alias("duration_ns"),
    )


def dictionary_stats(points: DataFrame) -> DataFrame:
    """Distinct strings (keys and values) and distinct tag sets."""
    sets = points.select("tags").distinct()
    strings = sets.select(F.explode(F.flatten(F.transform("tags", lambda p: F.array(p["key"], p["value"])))).alias("s")).agg(F.countDistinct("s").alias("strings"))
    return strings.crossJoin(F.broadcast(sets.agg(F.count("*").alias("tagsets"))))  # one row each


def interval_counts(points: DataFrame, resolution_ns: int = 1) -> DataFrame:
    """(mode, intervals) for every build family."""
    at = points.select(bucket(F.col("ts_ns"), resolution_ns).alias("ts_ns"), "tags")
    modes = {
        "unmerged": build.unmerged(points),
        "neighbour_runs": build.neighbour_runs(at),
        "islands": build.islands(points, resolution_ns),
        "bitmap": build.postings(points, resolution_ns).select("bucket_ns").distinct(),
    }
    return reduce(DataFrame.union, (df.agg(F.lit(m).alias("mode"), F.count("*").alias("intervals")) for m, df in modes.items()))


def compression_ratio(points: DataFrame, resolution_ns: int = 1) -> DataFrame:
    n = build.islands(points, resolution_ns).agg(F.count("*").alias("intervals"))
    return points.agg(F.count("*").alias("points")).crossJoin(F.broadcast(n)).withColumn("ratio", F.col("points") / F.col("intervals"))  # one row each


def interval_scaling(points: DataFrame, resolutions_ns: list[int]) -> DataFrame:
    """Per resolution the islands, the buckets, and how many fewer these are.

    All resolutions are counted in one pass over the points.
    """
    each = points.select("tags", F.explode(F.array(*(F.struct(F.lit(r).cast("long").alias("r"), bucket(F.col("ts_ns"), r).alias("b")) for r in resolutions_ns))).alias("x"))
    pairs = each.select(F.col("x.r").alias("resolution_ns"), F.col("x.b").alias("b"), "tags").distinct()
    per = pairs.groupBy("resolution_ns", "b").agg(F.count("*").alias("n")).groupBy("resolution_ns").agg(F.sum("n").alias("islands"), F.count("*").alias("buckets"))
    return per.withColumn("reduction", F.col("islands") / F.col("buckets"))


def results_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results has, repeats counted."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).union(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def out_of_order(points: DataFrame, position: str, groups: int = 1 << 20) -> DataFrame:
    """How many points come, by ``position``, after a later one.

    A running maximum within stretches, on top of the maximum of those before.
    """
    from pyspark.sql import Window

    rows = points.select("ts_ns", F.col(position).alias("p"), F.floor(F.col(position) / groups).alias("g"))
    before = rows.groupBy("g").agg(F.max("ts_ns").alias("m")).select("g", F.max("m").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    within = F.max("ts_ns").over(Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    behind = F.col("ts_ns") < F.greatest(within, F.col("earlier"))
    return rows.join(before, "g").select(behind.alias("late")).agg(F.coalesce(F.sum(F.col("late").cast("long")), F.lit(0)).alias("out_of_order"))
