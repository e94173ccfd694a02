"""Streaming builds that end with the tables of the batch builds.

No watermark by default: late points are never dropped.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronotag.functions.timeutil import bucket
from chronotag.operators import build
from chronotag.plans.index import NoData

TAGS = "array<struct<key:string,value:string>>"
SCHEMA = f"start_ns long, stop_ns long, tags {TAGS}"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files, or one file, as a stream; ``path`` may be in any store."""
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _folder(root: str, name: str) -> str:
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _run(df: DataFrame, root: str, name: str) -> str:
    """Write all that is available to a Parquet folder; its path."""
    out = _folder(root, name)
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def stream_postings(points: DataFrame, resolution_ns: int, root: str) -> DataFrame:
    """Each (bucket, tag set) once, whatever the order of arrival; the state is
    one key for each."""
    spark = points.sparkSession
    pairs = points.select(bucket(F.col("ts_ns"), resolution_ns).alias("bucket_ns"), "tags").dropDuplicates(["bucket_ns", "tags"])
    return spark.read.schema(f"bucket_ns long, tags {TAGS}").parquet(_run(pairs, root, "postings"))


@dataclass
class StreamStats:
    """Counters of a streaming build; they grow while it runs."""

    points: int = 0
    batches: int = 0
    tagsets: int = 0
    max_ns: int | None = None
    #: A batch held a point earlier than one of a batch before.
    out_of_order: bool = False
    seconds: float = 0.0

    @property
    def points_per_batch(self) -> float:
        return self.points / self.batches if self.batches else 0.0

    def seen(self, batch: DataFrame) -> bool:
        """Count a batch; whether it has points."""
        n, lo, hi = batch.agg(F.count("*"), F.min("ts_ns"), F.max("ts_ns")).first()
        self.points += n
        self.batches += 1
        if n:
            self.out_of_order |= self.max_ns is not None and lo < self.max_ns
            self.max_ns = hi if self.max_ns is None else max(hi, self.max_ns)
        return n > 0

    def checked(self) -> StreamStats:
        """Itself, or NoData if there were no points."""
        if not self.points:
            raise NoData("no points came")
        return self


#: Parts of an index by tag set; a batch rewrites only the parts that it touches.
PARTS = 64


class ChunkedBuild:
    """Islands of a stream: each micro-batch is merged into the parts of the
    index that hold its tag sets, as a new version of these parts.

    A batch that is run again writes the same versions again, so restarts are
    safe; ``stats`` counts while the stream runs.  The version before the last
    is removed, older ones are gone by then.
    """

    def __init__(self, spark: SparkSession, resolution_ns: int, folder: str):
        self.spark, self.resolution_ns, self.folder, self.stats = spark, resolution_ns, folder, StreamStats()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(folder).getFileSystem(conf)

    def _versions(self, below: int) -> dict[int, list[int]]:
        """The versions of each part that batches before ``below`` have written."""
        out: dict[int, list[int]] = {}
        for f in self._store.globStatus(self._path(f"{self.folder}/v*/part=*")) or ():
            version, part = f.getPath().getParent().getName(), f.getPath().getName()
            if int(version[1:]) < below:
                out.setdefault(int(part[5:]), []).append(int(version[1:]))
        return {p: sorted(v) for p, v in out.items()}

    def process(self, batch: DataFrame, number: int) -> None:
        began = time.perf_counter()
        batch = batch.persist()
        try:
            if self.stats.seen(batch):
                part = F.pmod(F.xxhash64("tags"), F.lit(PARTS)).cast("int")
                own = build.islands(batch, self.resolution_ns).withColumn("part", part)
                touched = [r[0] for r in batch.select(part).distinct().collect()]  # PARTS at most
                before = self._versions(number)
                old = [f"{self.folder}/v{before[p][-1]}/part={p}" for p in touched if p in before]
                if old:
                    rows = self.spark.read.schema(SCHEMA).parquet(*old).withColumn("part", part).unionByName(own)
                    own = build.merge_intervals(rows, "tags", "part")
                own.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/v{number}")
                for p in touched:
                    for version in before.get(p, [])[:-1]:
                        self._store.delete(self._path(f"{self.folder}/v{version}/part={p}"), True)
        finally:
            batch.unpersist()
            self.stats.seconds += time.perf_counter() - began

    def table(self) -> DataFrame:
        """The islands so far."""
        now = [f"{self.folder}/v{v[-1]}/part={p}" for p, v in self._versions(1 << 62).items()]
        return self.spark.read.schema(SCHEMA).parquet(*now) if now else self.spark.createDataFrame([], SCHEMA)

    def run(self, points: DataFrame) -> ChunkedBuild:
        """Process all that is available of a stream."""
        points.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).start().awaitTermination()
        self.stats.tagsets = self.table().select("tags").distinct().count()
        return self


def stream_islands(points: DataFrame, resolution_ns: int, root: str) -> DataFrame:
    """Islands of all that is available of a stream (see :class:`ChunkedBuild`)."""
    return ChunkedBuild(points.sparkSession, resolution_ns, _folder(root, "islands")).run(points).table()


def stream_islands_stateful(points: DataFrame, resolution_ns: int, root: str) -> DataFrame:
    """One open interval per tag set as state, in a single pass.

    Every batch gives the intervals that it closed and, as far as it has come,
    the open one; merging them per tag set gives the islands.  A point that
    comes late closes an interval early, which the merge repairs.
    """
    spark = points.sparkSession

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, stop = state.get if state.exists else (None, None)
        out = []
        for at in sorted({t for b in batches for t in b["ts_ns"]}):
            if stop is not None and at == stop:
                stop = at + 1
            elif start is None or not start <= at < stop:
                if start is not None:
                    out.append((start, stop))
                start, stop = at, at + 1
        out.append((start, stop))
        state.update((start, stop))
        yield pd.DataFrame({"key": [key[0]] * len(out), "start_ns": [s for s, _ in out], "stop_ns": [e for _, e in out]})

    keyed = points.select(bucket(F.col("ts_ns"), resolution_ns).alias("ts_ns"), F.to_json("tags").alias("key"))
    steps = keyed.groupBy("key").applyInPandasWithState(step, "key string, start_ns long, stop_ns long", "start long, stop long", "append", GroupStateTimeout.NoTimeout)
    found = spark.read.schema("key string, start_ns long, stop_ns long").parquet(_run(steps, root, "stateful"))
    return build.merge_intervals(found, "key").select("start_ns", "stop_ns", F.from_json("key", TAGS).alias("tags"))
