"""Line protocol: ``measurement,k=v,k=v fields timestamp``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASUREMENT = "_measurement"


def parse_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(ts_ns, tags, *keep) of the lines that can be read.

    The third part is the time; fields are ignored and nothing is escaped.
    Blank lines, comments (#), lines of fewer parts and unreadable times are
    left out.  The measurement is the tag ``_measurement``.
    """
    part = F.split(F.trim(column), r"\s+")
    head = F.split(F.get("p", F.lit(0)), ",")
    tags = F.expr("transform(filter(slice(h, 2, size(h)), x -> instr(x, '=') > 0), x -> struct(substring_index(x, '=', 1) AS key, substring(x, instr(x, '=') + 1) AS value))")
    name = F.array(F.struct(F.lit(MEASUREMENT).alias("key"), F.get("h", F.lit(0)).alias("value")))
    return (
        lines.select(part.alias("p"), *keep)
        .where((F.size("p") >= 3) & ~F.startswith(F.get("p", F.lit(0)), F.lit("#")))
        .select(F.expr("try_cast(p[2] AS BIGINT)").alias("ts_ns"), head.alias("h"), *keep)
        .where(F.col("ts_ns").isNotNull())
        .select("ts_ns", F.array_sort(F.concat(name, tags)).alias("tags"), *keep)
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def write_lines(points: DataFrame, measurement: str = "points") -> DataFrame:
    """Points as lines (value), for tests and exchange."""
    tags = F.array_join(F.transform("tags", lambda p: F.concat(F.lit(","), p["key"], F.lit("="), p["value"])), "")
    return points.select(F.concat(F.lit(measurement), tags, F.lit(" v=1 "), F.col("ts_ns").cast("string")).alias("value"))
