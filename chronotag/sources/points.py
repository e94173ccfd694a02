"""Points (ts_ns, tags) from tables, with roles from metadata or names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotag.functions.tags import series_key, tagset
from chronotag.functions.timeutil import nanos

#: Fixed names of the column role metadata, and of unmarked time columns.
ROLE_KEY = "iox::column::type"
TIME_ROLE, TAG_ROLE = "iox::column_type::timestamp", "iox::column_type::tag"
TIME_NAMES = ("time", "timestamp", "_time", "eventtime")


@dataclass(frozen=True)
class Roles:
    time: str
    tags: tuple[str, ...]


def infer_roles(schema: T.StructType, metadata: dict[str, str] | None = None, all_strings: bool = False) -> Roles:
    """The time and tag columns of a schema.

    Marked columns have the role they are marked with.  Unmarked ones named
    like a time are time; the last candidate wins.  Unmarked strings are tags
    if nothing is marked.  With ``all_strings`` every string column counts, but
    the time.  Spark drops Parquet field metadata, so it is passed in (see
    :func:`parquet_roles`) or taken from the fields.
    """
    marks = metadata if metadata is not None else {f.name: f.metadata[ROLE_KEY] for f in schema if ROLE_KEY in f.metadata}
    time, tags = None, []
    for f in schema:
        mark, text = marks.get(f.name), isinstance(f.dataType, T.StringType)
        if mark == TIME_ROLE or mark is None and f.name.lower() in TIME_NAMES:
            time = f.name
        elif text and (all_strings or mark == TAG_ROLE or mark is None and not marks):
            tags.append(f.name)
    if time is None:
        raise ValueError("no time column")
    return Roles(time, tuple(t for t in tags if t != time))


def parquet_roles(path: str) -> dict[str, str]:
    """Role marks in a local Parquet file's footer."""
    import pyarrow.parquet as pq

    return {f.name: f.metadata[ROLE_KEY.encode()].decode() for f in pq.read_schema(path) if f.metadata and ROLE_KEY.encode() in f.metadata}


#: The session setting that files with nanosecond times need.
NANOS_AS_LONG = "spark.sql.legacy.parquet.nanosAsLong"


def read_parquet(spark: SparkSession, *paths: str, skip_corrupt: bool = False) -> DataFrame:
    """Parquet with nanosecond times as BIGINT, for which the session must have
    NANOS_AS_LONG set; ``skip_corrupt`` leaves unreadable files out."""
    try:
        return spark.read.option("ignoreCorruptFiles", skip_corrupt).parquet(*paths)
    except AnalysisException as e:
        if "NANOS" in str(e) and spark.conf.get(NANOS_AS_LONG, "false") != "true":
            raise ValueError(f"set {NANOS_AS_LONG} to true in the session to read nanosecond times") from e
        raise


def extract_points(df: DataFrame, time: str | None = None, tags: list[str] | None = None, null_policy: str = "empty", keep: tuple[str, ...] = ()) -> DataFrame:
    """(ts_ns, tags, *keep) of a table.

    Rows without a time are dropped.  Roles that are not given are inferred.
    """
    if time is None or tags is None:
        roles = infer_roles(df.schema)
        time, tags = time or roles.time, list(roles.tags) if tags is None else tags
    return df.where(F.col(time).isNotNull()).select(nanos(F.col(time), df.schema[time].dataType).alias("ts_ns"), tagset(tags, null_policy).alias("tags"), *keep)


def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order, ascending, nulls last."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in order)).limit(n)


def sort_by_time(df: DataFrame, time: str, *more: str) -> DataFrame:
    """A global sort by time, nulls last; it spills as any Spark sort does."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in (time, *more)))


def max_cardinality(points: DataFrame, n: int, *order: str) -> DataFrame:
    """Points of the first n distinct tag sets by first appearance.

    One aggregate finds each tag set's first appearance and a top-n keeps n of
    them; what is joined back has n rows.
    """
    first = points.groupBy("tags").agg(F.min(F.struct(*order)).alias("_first"))
    admitted = first.orderBy("_first").limit(n).select("tags")
    return points.join(F.broadcast(admitted) if n <= 100_000 else admitted, "tags", "left_semi")


def sorted_rows(points: DataFrame) -> DataFrame:
    """Points in order of time, then tag set."""
    return points.orderBy("ts_ns", "tags")


def sorted_series(points: DataFrame) -> DataFrame:
    """(ts_ns, series) in order of time, then series key."""
    return points.select("ts_ns", series_key(F.col("tags")).alias("series")).orderBy("ts_ns", "series")
