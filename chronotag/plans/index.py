"""The index as an object: build, query, append, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotag.functions.timeutil import bucket, ceil_ns, floor_ns
from chronotag.operators import build, query, stats

MODES = ("bitmap", "islands", "neighbour_runs", "unmerged")
#: Stored postings are partitioned by this much time.
PARTITION_NS = 86_400 * 10**9


class NoData(ValueError):
    """Nothing to index."""


class ResolutionMismatch(ValueError):
    """Appended points have another resolution than the index."""


#: Tasks that write a day, so that no day is one task's.
TASKS_PER_DAY = 16


@dataclass(frozen=True)
class TagIndex:
    """Which tag sets were present when.

    ``table`` is (bucket_ns, tags) for mode ``bitmap`` and (start_ns, stop_ns,
    tags) otherwise.  All modes answer alike; the bitmap mode is the one to use.
    """

    table: DataFrame
    resolution_ns: int = 1
    mode: str = "bitmap"
    stored_at: str | None = None

    @classmethod
    def build(cls, points: DataFrame, resolution_ns: int = 1, mode: str = "bitmap", prebucketed: bool = False) -> TagIndex:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if mode == "bitmap":
            return cls(build.postings(points, resolution_ns, prebucketed), resolution_ns, mode)
        if mode == "islands":
            return cls(build.islands(points, resolution_ns), resolution_ns, mode)
        at = points.withColumn("ts_ns", bucket(F.col("ts_ns"), resolution_ns))
        return cls(build.neighbour_runs(at) if mode == "neighbour_runs" else build.unmerged(at), resolution_ns, mode)

    def append(self, points: DataFrame, resolution_ns: int | None = None) -> TagIndex:
        if resolution_ns is not None and resolution_ns != self.resolution_ns:
            raise ResolutionMismatch(f"index has {self.resolution_ns} ns, points have {resolution_ns} ns")
        if self.mode == "bitmap":
            table = build.append_postings(self.table, points, self.resolution_ns)
        elif self.mode == "islands":
            table = build.append_islands(self.table, points, self.resolution_ns)
        else:
            own = TagIndex.build(points, self.resolution_ns, self.mode).table
            table = self.table.unionByName(own)
            table = build.merge_intervals(table) if self.mode == "neighbour_runs" else table
        return TagIndex(table, self.resolution_ns, self.mode)

    def query_point(self, t: int) -> DataFrame:
        at = floor_ns(t, self.resolution_ns)
        if self.mode == "bitmap":
            return self.table.where(F.col("bucket_ns") == at).select("tags").distinct()
        return query.query_intervals_point(self.table, at)

    def query_range(self, lo: int, hi: int) -> DataFrame:
        lo, hi = floor_ns(lo, self.resolution_ns), ceil_ns(hi, self.resolution_ns)
        if self.mode == "bitmap":
            return self.table.where((F.col("bucket_ns") >= lo) & (F.col("bucket_ns") < hi)).select("tags").distinct()
        if lo >= hi:
            return self.table.limit(0).select("tags")
        return query.query_intervals(self.table, lo, hi)

    def query_full_range(self) -> DataFrame:
        return self.table.select("tags").distinct()

    def query_points(self, probes: DataFrame) -> DataFrame:
        return query.query_points_batch(self._postings(), probes, self.resolution_ns)

    def query_ranges(self, probes: DataFrame) -> DataFrame:
        return query.query_ranges_batch(self._postings(), probes, self.resolution_ns)

    def _postings(self) -> DataFrame:
        if self.mode != "bitmap":
            raise ValueError("batches are answered by the bitmap mode")
        return self.table

    def bounds(self) -> tuple[int, int]:
        if self.mode == "bitmap":
            lo, hi = query.bounds(self.table, self.resolution_ns).first()
        else:
            lo, hi = self.table.agg(F.min("start_ns"), F.max("stop_ns")).first()
        if lo is None:
            raise NoData("the index is empty")
        return lo, hi

    def interval_count(self) -> int:
        return self.table.select("bucket_ns").distinct().count() if self.mode == "bitmap" else self.table.count()

    def unique_tagsets(self) -> int:
        return self.query_full_range().count()

    def dictionary_stats(self) -> DataFrame:
        return stats.dictionary_stats(self.table)

    def size_bytes(self) -> int:
        """Bytes of the stored index's files; of one that is not stored, the
        optimizer's estimate."""
        spark = self.table.sparkSession
        plan = self.table._jdf.queryExecution().optimizedPlan()
        if self.stored_at:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.stored_at)
            return int(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength())
        return int(plan.stats().sizeInBytes())

    def write(self, path: str) -> None:
        """Store by day, each day in a few files, so a range reads only its days."""
        at = "bucket_ns" if self.mode == "bitmap" else "start_ns"
        day, part = bucket(F.col(at), PARTITION_NS), F.pmod(F.xxhash64("tags"), F.lit(TASKS_PER_DAY))
        self.table.withColumn("day_ns", day).repartition("day_ns", part).sortWithinPartitions(at).write.partitionBy("day_ns").mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, resolution_ns: int, mode: str = "bitmap") -> TagIndex:
        return cls(spark.read.parquet(path).drop("day_ns"), resolution_ns, mode, path)
