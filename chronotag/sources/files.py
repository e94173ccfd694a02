"""Files of points: kinds, time bounds, consecutive runs, checks."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotag.functions.timeutil import parse_duration
from chronotag.sources.points import TIME_NAMES

GAP_NS = 25 * 3600 * 10**9


@dataclass(frozen=True)
class LoadConfig:
    """What to load and within which limits; None is no limit."""

    path: str | None = None
    kind: str | None = None
    max_rows: int | None = None
    max_duration_ns: int | None = None
    max_cardinality: int | None = None
    resolution_ns: int = 3600 * 10**9
    files_per_trigger: int | None = None
    as_stream: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> LoadConfig:
        """Settings LOAD_PATH, LOAD_KIND, LOAD_MAX_ROWS, LOAD_MAX_DURATION,
        LOAD_MAX_CARDINALITY, LOAD_RESOLUTION, LOAD_FILES_PER_TRIGGER and
        LOAD_STREAM; unreadable ones count as not given."""
        env = os.environ if env is None else env
        number = lambda k: int(env[k]) if env.get(k, "").isdigit() else None
        kind = {"parquet": "parquet", "lineprotocol": "lineprotocol", "lp": "lineprotocol"}.get(env.get("LOAD_KIND", "").lower())
        return cls(
            env.get("LOAD_PATH"),
            kind,
            number("LOAD_MAX_ROWS"),
            parse_duration(env.get("LOAD_MAX_DURATION", "")),
            number("LOAD_MAX_CARDINALITY"),
            parse_duration(env.get("LOAD_RESOLUTION", "1h")) or cls.resolution_ns,
            number("LOAD_FILES_PER_TRIGGER"),
            env.get("LOAD_STREAM", "").lower() == "true",
        )


def input_kind(path: str, names: list[str] | None = None) -> str:
    """``lineprotocol`` or ``parquet``, by extension; a folder by its first
    file of either kind; Parquet otherwise."""
    for name in [path, *(names or ())]:
        if name.endswith(".lp"):
            return "lineprotocol"
        if name.endswith(".parquet"):
            return "parquet"
    return "parquet"


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, or a file itself, in any store, by name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    return sorted(f.getPath().toString() for f in found if f.isFile() and not f.getPath().getName().startswith(("_", ".")))


#: Nanoseconds in a unit of Parquet's time annotation.
_UNITS = {"MILLIS": 10**6, "MICROS": 10**3, "NANOS": 1}


@dataclass(frozen=True)
class Footer:
    """A Parquet file's rows and, where its footer tells them, time bounds."""

    file: str
    rows: int
    min_ns: int | None
    max_ns: int | None


def footers(spark: SparkSession, path: str, time: str | None = None, skip_corrupt: bool = False) -> list[Footer]:
    """Read the footers of a folder's Parquet files, and nothing else of them.

    ``time`` is the time column; if not given, columns named like a time.
    """
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in list_files(spark, path):
        if not name.endswith(".parquet"):
            continue
        rows, bounds = 0, []
        try:
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf))
        except Exception:
            if skip_corrupt:
                continue
            raise
        for block in reader.getFooter().getBlocks():
            rows += block.getRowCount()
            for column in block.getColumns():
                label = column.getPath().toDotString()
                if label != time if time else label.lower() not in TIME_NAMES:
                    continue
                stats, kind = column.getStatistics(), column.getPrimitiveType()
                if kind.getPrimitiveTypeName().toString() == "INT64" and stats is not None and stats.hasNonNullValue():
                    unit = next((n for u, n in _UNITS.items() if u in str(kind.getLogicalTypeAnnotation())), 1)
                    bounds += [int(stats.genericGetMin()) * unit, int(stats.genericGetMax()) * unit]
        reader.close()
        out.append(Footer(name, rows, min(bounds, default=None), max(bounds, default=None)))
    return out


def consecutive(found: list[Footer], gap_ns: int = GAP_NS, max_ns: int | None = None) -> list[Footer]:
    """The first run of files without a gap, in order of time, up to and with the
    file that reaches ``max_ns`` from the start; files without bounds are left out."""
    out: list[Footer] = []
    last = None
    for f in sorted((f for f in found if f.min_ns is not None), key=lambda f: (f.min_ns, f.file)):
        if out and (f.min_ns - last > gap_ns or max_ns is not None and max(x.max_ns for x in out) - out[0].min_ns >= max_ns):
            break
        out.append(f)
        last = f.max_ns
    return out


def file_time_bounds(points: DataFrame, file: str = "file") -> DataFrame:
    """Least and largest time, and rows, per file."""
    return points.groupBy(file).agg(F.min("ts_ns").alias("min_ns"), F.max("ts_ns").alias("max_ns"), F.count("*").alias("rows"))


def contiguous_runs(bounds: DataFrame, gap_ns: int = GAP_NS, file: str = "file") -> DataFrame:
    """Number the runs of files in which no gap exceeds ``gap_ns``; run 1 is
    what a consecutive load takes.  ``bounds`` has a row for each file."""
    order = Window.orderBy("min_ns", file)
    gap = F.col("min_ns") - F.lag("max_ns").over(order)
    return bounds.withColumn("run", (F.sum(F.when(gap > gap_ns, 1).otherwise(0)).over(order) + 1).cast("long"))


def limit_duration(points: DataFrame, max_ns: int) -> DataFrame:
    """Points within ``max_ns`` of the first one."""
    first = points.agg(F.min("ts_ns").alias("_first"))  # one row
    return points.join(F.broadcast(first), F.col("ts_ns") - F.col("_first") <= max_ns).drop("_first")


def count_rows(df: DataFrame) -> DataFrame:
    """Rows in all, from Parquet footers."""
    return df.agg(F.count("*").alias("rows"))


def check_sorted(rows: DataFrame, position: str, ts: str = "ts_ns", groups: int = 1 << 20) -> DataFrame:
    """Inversions of time in the order of ``position`` (a whole number).

    Neighbours are compared within stretches of positions and each stretch's
    last row with the next one's first, so nothing runs in a single task but
    over one row for each stretch.
    """
    stretch = F.floor(F.col(position) / groups)
    own = Window.partitionBy("g").orderBy(position)
    inside = rows.select(F.col(position), F.col(ts).alias("t"), stretch.alias("g")).withColumn("before", F.lag("t").over(own))
    parts = inside.groupBy("g").agg(
        F.count("*").alias("n"),
        F.sum((F.col("t") < F.col("before")).cast("long")).alias("bad"),
        F.min_by("t", position).alias("first"),
        F.max_by("t", position).alias("last"),
        F.max("t").alias("most"),
    )
    across = parts.withColumn("bad", F.coalesce("bad", F.lit(0)) + F.coalesce((F.col("first") < F.lag("last").over(Window.orderBy("g"))).cast("long"), F.lit(0)))
    return across.agg(
        F.sum("n").cast("long").alias("rows"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("inversions"),
        F.min_by("first", "g").alias("first_ns"),
        F.max_by("last", "g").alias("last_ns"),
    )
