"""The index's queries over the test tables, and DuckDB SQL for the same rows.

Points come from ``events`` (tags event_type and user, or event_type alone),
day numbers of ``lineitem`` (return flag, line status) and ``orders``;
intervals are each order's ship days.  Tag sets leave a query as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotag.functions.tags import project, row_text, series_key, tagset
from chronotag.functions.timeutil import DAY, HOUR, bucket, nanos
from chronotag.operators import bitmaps, build, intervals, query, stats
from chronotag.plans.index import TagIndex
from chronotag.plans.staging import shared_root
from chronotag.sources import files, generator, lineprotocol, load, points
from chronotag.streaming import builds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: 2024-01-01 and other instants of ``events``, in ns.
JAN1 = 1_704_067_200_000_000_000
LO, HI = JAN1 + 3 * DAY + 5 * 60 * 10**9, JAN1 + 9 * DAY + 17 * 60 * 10**9
POINT = JAN1 + 7 * DAY + 90 * 60 * 10**9
RESOLUTIONS = [30 * 10**9, 60 * 10**9, 300 * 10**9, 900 * 10**9, HOUR]


def registered(sql: str | None = None):
    """Enter a query under its function's name, with its SQL."""

    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = WITH + sql
        return f

    return enter


WITH = f"""
WITH e AS (SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, 'event_type=' || event_type AS kind,
    'event_type=' || event_type || ',user_id=' || CAST(user_id AS VARCHAR) AS tags, value FROM events),
h AS (SELECT DISTINCT ts_ns // {HOUR} * {HOUR} AS bucket_ns, kind AS tags FROM e),
l AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS ts_ns,
    'l_linestatus=' || l_linestatus || ',l_returnflag=' || l_returnflag AS tags FROM lineitem),
o AS (SELECT o_orderkey, epoch_us(o_orderdate) * 1000 AS ts_ns,
    'o_orderpriority=' || o_orderpriority || ',o_orderstatus=' || o_orderstatus AS tags FROM orders),
iv AS (SELECT l_orderkey AS id, CAST(min(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS BIGINT) AS "start",
    CAST(max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) + 1 AS BIGINT) AS stop FROM lineitem GROUP BY l_orderkey),
probes AS (SELECT CAST(i AS BIGINT) AS q_id, CAST(8100 + i * 317 AS BIGINT) AS q_start, CAST(8100 + i * 317 + i % 3 * 40 AS BIGINT) AS q_stop FROM range(8) t(i)),
asks AS (SELECT CAST(i AS BIGINT) AS probe_id, {JAN1} + i * {29 * 60 * 10**9} AS t FROM range(1000) t(i)),
spans AS (SELECT CAST(i AS BIGINT) AS probe_id, {JAN1} + i * {5 * HOUR + 7 * 10**9} AS lo, {JAN1} + i * {5 * HOUR + 7 * 10**9} + (i % 9) * {11 * HOUR} + {10**9} AS hi FROM range(100) t(i))
"""
ISLANDS = """SELECT min({t}) AS start_ns, max({t}) + 1 AS stop_ns, tags FROM (
  SELECT *, {t} - row_number() OVER (PARTITION BY tags ORDER BY {t}) AS run FROM ({rows})) GROUP BY tags, run"""
UNION = """SELECT min(s) AS start_ns, max(e) AS stop_ns, tags FROM (SELECT *, sum(fresh) OVER (PARTITION BY tags ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY tags ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({rows}))) GROUP BY tags, run"""


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, *tags: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return points.extract_points(read(spark, d, "events"), "ts", list(tags or ("event_type",)), keep=keep)


def ship_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.to_date(F.lit("1970-01-01"))).cast("long")
    return read(spark, d, "lineitem").select(day.alias("ts_ns"), tagset(["l_returnflag", "l_linestatus"]).alias("tags")).where("ts_ns IS NOT NULL")


def order_points(spark: SparkSession, d: str) -> DataFrame:
    return points.extract_points(read(spark, d, "orders"), "o_orderdate", ["o_orderpriority", "o_orderstatus"])


def ship_intervals(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.to_date(F.lit("1970-01-01"))).cast("long")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), day.alias("day")).groupBy("id").agg(F.min("day").alias("start"), (F.max("day") + 1).alias("stop"))


def text(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", row_text(F.col("tags")))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return build.postings(events(spark, d), HOUR)


# --- sources ---------------------------------------------------------------


@registered("SELECT event_id, ts_ns, kind AS tags FROM e")
def scan_points(spark, d):
    return text(events(spark, d, keep=("event_id",)))


@registered("SELECT ts_ns, tags FROM e")
def sorted_points(spark, d):
    return text(events(spark, d, "event_type", "user_id").orderBy("ts_ns", "tags"))


@registered("SELECT event_id, ts_ns, value FROM e ORDER BY ts_ns, event_id LIMIT 500")
def ordered_scan(spark, d):
    df = read(spark, d, "events")
    first = points.limit_rows(df.select("ts", "event_id", "value"), 500, "ts", "event_id")
    return first.select("event_id", nanos(F.col("ts"), df.schema["ts"].dataType).alias("ts_ns"), "value")


@registered("SELECT o_orderkey, ts_ns FROM o")
def sort_by_time(spark, d):
    df = read(spark, d, "orders")
    return points.sort_by_time(df, "o_orderdate", "o_orderkey").select("o_orderkey", nanos(F.col("o_orderdate"), df.schema["o_orderdate"].dataType).alias("ts_ns"))


@registered("SELECT event_id, ts_ns FROM e ORDER BY ts_ns, event_id LIMIT 1000")
def limit_rows(spark, d):
    return points.limit_rows(events(spark, d, keep=("event_id",)).select("event_id", "ts_ns"), 1000, "ts_ns", "event_id")


@registered("SELECT event_id, ts_ns, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S') AS at FROM e")
def cast_time(spark, d):
    df = events(spark, d, keep=("event_id",))
    return df.select("event_id", "ts_ns", F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(ts_ns div 1000 as decimal(20, 0)) / 1000000)"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@registered("SELECT count(*) AS rows FROM e")
def count_rows(spark, d):
    return files.count_rows(read(spark, d, "events"))


@registered("SELECT event_id, kind AS tags FROM e")
def project_tags(spark, d):
    df = events(spark, d, "event_type", "user_id", keep=("event_id",))
    return df.select("event_id", row_text(project(F.col("tags"), ["event_type"])).alias("tags"))


def _with_null(spark, d, policy: str) -> DataFrame:
    df = read(spark, d, "orders").withColumn("x", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")))
    return text(points.extract_points(df, "o_orderdate", ["x", "o_orderpriority"], policy, keep=("o_orderkey",)).drop("ts_ns"))


_X = "CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END"


@registered("SELECT o_orderkey, 'o_orderpriority=' || o_orderpriority || ',x=' || coalesce(" + _X + ", 'null') AS tags FROM orders")
def extract_tags(spark, d):
    return _with_null(spark, d, "literal")


@registered("SELECT o_orderkey, 'o_orderpriority=' || o_orderpriority || ',x=' || coalesce(" + _X + ", '') AS tags FROM orders")
def extract_encode_tags(spark, d):
    return _with_null(spark, d, "empty")


@registered("SELECT event_id, ts_ns, kind || ',props=' || props AS tags FROM e JOIN events USING (event_id)")
def extract_rows(spark, d):
    df = read(spark, d, "events")
    roles = points.infer_roles(df.withColumnRenamed("ts", "time").schema, all_strings=True)
    return text(points.extract_points(df, "ts", list(roles.tags), "literal", keep=("event_id",)))


@registered("SELECT o_orderkey, 'o_orderpriority=' || o_orderpriority || coalesce(',x=' || " + _X + ", '') AS series FROM orders")
def series_key_text(spark, d):
    df = read(spark, d, "orders").withColumn("x", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")))
    return df.select("o_orderkey", series_key(tagset(["o_orderpriority", "x"])).alias("series"))


QUERIES["series_key"], ORACLES["series_key"] = QUERIES.pop("series_key_text"), ORACLES.pop("series_key_text")


@registered("SELECT event_id, tags AS row FROM e")
def row_text_query(spark, d):
    return events(spark, d, "event_type", "user_id", keep=("event_id",)).select("event_id", row_text(F.col("tags")).alias("row"))


QUERIES["row_text"], ORACLES["row_text"] = QUERIES.pop("row_text_query"), ORACLES.pop("row_text_query")


@registered("SELECT event_id, e.tags FROM e JOIN (SELECT tags FROM e GROUP BY tags ORDER BY min((ts_ns, event_id)) LIMIT 50) USING (tags)")
def max_cardinality(spark, d):
    df = events(spark, d, "event_type", "user_id", keep=("event_id",))
    return text(points.max_cardinality(df, 50, "ts_ns", "event_id")).select("event_id", "tags")


@registered("SELECT count(DISTINCT tags) AS tagsets FROM e")
def tagset_cardinality(spark, d):
    return stats.cardinality(events(spark, d, "event_type", "user_id"))


@registered(f"SELECT CAST(ceil((max(ts_ns) - min(ts_ns)) / {HOUR}) AS BIGINT) AS buckets FROM e")
def bucket_span(spark, d):
    return stats.bucket_span(events(spark, d), HOUR)


@registered("SELECT count(*) AS rows, count(DISTINCT tags) AS tagsets, min(ts_ns) AS min_ns, max(ts_ns) AS max_ns, max(ts_ns) - min(ts_ns) AS duration_ns FROM o")
def load_stats(spark, d):
    return stats.load_stats(order_points(spark, d))


_FILE_DAYS = f"SELECT ts_ns // {7 * DAY} AS file, min(ts_ns) AS min_ns, max(ts_ns) AS max_ns, count(*) AS rows FROM o GROUP BY 1"


@registered(_FILE_DAYS)
def file_time_bounds(spark, d):
    return files.file_time_bounds(order_points(spark, d).withColumn("file", F.floor(F.col("ts_ns") / (7 * DAY)).cast("long")))


@registered(f"SELECT file, min_ns, max_ns, rows, CAST(1 + sum(CASE WHEN min_ns - before > {25 * HOUR} THEN 1 ELSE 0 END) OVER (ORDER BY min_ns, file) AS BIGINT) AS run FROM (SELECT *, lag(max_ns) OVER (ORDER BY min_ns, file) AS before FROM ({_FILE_DAYS}))")
def contiguous_runs(spark, d):
    return files.contiguous_runs(file_time_bounds(spark, d))


@registered("SELECT ts_ns, '_measurement=points,' || tags AS tags FROM e")
def line_protocol_parse(spark, d):
    return text(lineprotocol.parse_lines(lineprotocol.write_lines(events(spark, d, "event_type", "user_id"))))


@registered("SELECT count(*) AS rows, CAST(coalesce(sum(CASE WHEN ts_ns < b THEN 1 ELSE 0 END), 0) AS BIGINT) AS inversions, arg_min(ts_ns, o_orderkey) AS first_ns, arg_max(ts_ns, o_orderkey) AS last_ns FROM (SELECT *, lag(ts_ns) OVER (ORDER BY o_orderkey) AS b FROM o)")
def check_sorted(spark, d):
    df = read(spark, d, "orders")
    return files.check_sorted(df.select("o_orderkey", nanos(F.col("o_orderdate"), df.schema["o_orderdate"].dataType).alias("ts_ns")), "o_orderkey", groups=4096)


@registered("SELECT CAST(coalesce(sum(CASE WHEN ts_ns < m THEN 1 ELSE 0 END), 0) AS BIGINT) AS out_of_order FROM (SELECT *, max(ts_ns) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o)")
def out_of_order_count(spark, d):
    df = read(spark, d, "orders")
    return stats.out_of_order(df.select("o_orderkey", nanos(F.col("o_orderdate"), df.schema["o_orderdate"].dataType).alias("ts_ns")), "o_orderkey", groups=4096)


@registered(
    f"SELECT {generator.START} + s * {generator.STEP} AS time, chr(CAST(97 + i // 12 % 5 AS INT)) AS t0, chr(CAST(97 + i // 3 % 4 AS INT)) AS t1, chr(CAST(97 + i % 3 AS INT)) AS t2 FROM range(60) a(i), range(24) b(s)"
)
def gen_points(spark, d):
    return generator.generate_points(spark, 60, points=24, columns=3)


@registered("SELECT ts_ns, tags || ',props=' || props AS tags FROM e JOIN events USING (event_id)")
def sorted_rows(spark, d):
    return text(points.sorted_rows(events(spark, d, "event_type", "user_id", "props").select("ts_ns", F.expr("transform(array(0, 2, 1), i -> tags[i])").alias("tags"))))


@registered("SELECT ts_ns, tags AS series FROM e")
def sorted_series(spark, d):
    return points.sorted_series(events(spark, d, "event_type", "user_id"))


_ADMITTED = "SELECT {tags} AS tags, ts_ns FROM e WHERE kind IN (SELECT kind FROM e GROUP BY kind ORDER BY min((ts_ns, kind)) LIMIT 3) ORDER BY ts_ns, tags LIMIT 700"


@registered(_ADMITTED.format(tags="kind"))
def bounded_load(spark, d):
    config = files.LoadConfig(f"{d}/events.parquet", max_rows=700, max_cardinality=3, max_duration_ns=400 * DAY)
    return text(load.load(spark, config, "ts", ["event_type"]))


@registered(_ADMITTED.format(tags="'_measurement=points,' || kind"))
def line_protocol_load(spark, d):
    folder = f"{shared_root(spark)}/lines-{uuid.uuid4().hex}"
    lineprotocol.write_lines(events(spark, d)).write.text(folder)
    return text(load.load(spark, files.LoadConfig(folder, "lineprotocol", max_rows=700, max_cardinality=3)))


@registered("SELECT count(*) AS parquet_rows, count(*) AS line_rows, count(DISTINCT kind) AS tagsets, 0 AS only_in_one FROM e")
def loaders_agree(spark, d):
    """Both loaders over the same points: counts, and rows that only one has."""
    a = load.load(spark, files.LoadConfig(f"{d}/events.parquet"), "ts", ["event_type"])
    folder = f"{shared_root(spark)}/lines-{uuid.uuid4().hex}"
    lineprotocol.write_lines(a).write.text(folder)
    b = load.load(spark, files.LoadConfig(folder, "lineprotocol")).select("ts_ns", project(F.col("tags"), ["event_type"]).alias("tags"))
    a, b = text(a), text(b)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    each = [one(a, "parquet_rows"), one(b, "line_rows"), stats.cardinality(b), one(stats.results_diff(a, b), "only_in_one")]
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), each)  # one row each


@registered("SELECT count(*) AS rows, min(ts_ns) AS min_ns, max(ts_ns) AS max_ns FROM e")
def file_footers(spark, d):
    found = [(f.rows, f.min_ns, f.max_ns) for f in files.footers(spark, f"{d}/events.parquet", "ts")]
    return spark.createDataFrame(found, "rows long, min_ns long, max_ns long").agg(F.sum("rows").alias("rows"), F.min("min_ns").alias("min_ns"), F.max("max_ns").alias("max_ns"))


# --- builds ----------------------------------------------------------------


@registered(f"SELECT event_id, ts_ns // {HOUR} * {HOUR} AS bucket_ns FROM e")
def bucket_ts(spark, d):
    return events(spark, d, keep=("event_id",)).select("event_id", bucket(F.col("ts_ns"), HOUR).alias("bucket_ns"))


@registered("SELECT * FROM h")
def bucket_postings(spark, d):
    return text(hourly(spark, d))


@registered("SELECT * FROM h")
def prebucketed_build(spark, d):
    return text(build.postings(hourly(spark, d).withColumnRenamed("bucket_ns", "ts_ns"), HOUR, prebucketed=True))


@registered("SELECT bucket_ns, count(*) AS tagsets FROM h GROUP BY bucket_ns")
def tagsets_per_bucket(spark, d):
    return hourly(spark, d).groupBy("bucket_ns").agg(F.count("*").alias("tagsets"))


def _bitmaps(spark, d) -> tuple[DataFrame, DataFrame]:
    p = events(spark, d, "event_type", "user_id")
    ids = build.tagset_dictionary(p)
    return bitmaps.bitmaps(build.encode(build.postings(p, DAY), ids)), ids


_DAILY = f"SELECT DISTINCT ts_ns // {DAY} * {DAY} AS bucket_ns, tags FROM e"


@registered(_DAILY)
def bucket_bitmap(spark, d):
    maps, ids = _bitmaps(spark, d)
    return text(build.decode(bitmaps.ids(maps), ids)).select("bucket_ns", "tags")


@registered(f"SELECT bucket_ns, count(*) AS tagsets FROM ({_DAILY}) GROUP BY bucket_ns")
def bitmap_count_per_bucket(spark, d):
    return bitmaps.counts(_bitmaps(spark, d)[0])


@registered(f"SELECT bucket_ns, count(*) AS tagsets FROM ({_DAILY}) GROUP BY bucket_ns")
def bitmap_or_compact(spark, d):
    p = events(spark, d, "event_type", "user_id")
    ids = build.tagset_dictionary(p)
    early, late = (bitmaps.bitmaps(build.encode(build.postings(x, DAY), ids)) for x in (p.where(F.col("ts_ns") < POINT), p.where(F.col("ts_ns") >= POINT)))
    return bitmaps.counts(bitmaps.compact(early.union(late)))


@registered("SELECT count(*) AS rows, count(DISTINCT bucket_ns) AS buckets, count(DISTINCT tags) AS tagsets FROM h")
def bitmap_build(spark, d):
    """The flagship: an hourly bitmap index of all events, counted back."""
    p = events(spark, d)
    ids = build.tagset_dictionary(p)
    maps = bitmaps.bitmaps(build.encode(build.postings(p, HOUR), ids))
    return bitmaps.ids(maps).agg(F.count("*").alias("rows"), F.countDistinct("bucket_ns").alias("buckets"), F.countDistinct("tagset_id").alias("tagsets"))


@registered("SELECT ts_ns AS start_ns, ts_ns + 1 AS stop_ns, tags FROM l")
def unmerged_intervals(spark, d):
    return text(build.unmerged(ship_days(spark, d)))


_NEIGHBOURS = """SELECT min(ts_ns) AS start_ns, max(ts_ns) + 1 AS stop_ns, tags FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY tags ORDER BY ts_ns) AS run FROM (
    SELECT *, CASE WHEN lo AND lag(hi) OVER w AND lag(ts_ns) OVER w = ts_ns - 1 THEN 0 ELSE 1 END AS fresh FROM (
      SELECT *, tags = min(tags) OVER (PARTITION BY ts_ns) AS lo, tags = max(tags) OVER (PARTITION BY ts_ns) AS hi FROM (SELECT DISTINCT ts_ns, tags FROM l))
    WINDOW w AS (PARTITION BY tags ORDER BY ts_ns))) GROUP BY tags, run"""


@registered(_NEIGHBOURS)
def runs_neighbour(spark, d):
    return text(build.neighbour_runs(ship_days(spark, d)))


@registered(ISLANDS.format(t="ts_ns", rows="SELECT DISTINCT ts_ns, tags FROM l"))
def islands_1ns(spark, d):
    return text(build.islands(ship_days(spark, d)))


@registered(f"SELECT start_ns * {HOUR} AS start_ns, stop_ns * {HOUR} AS stop_ns, tags FROM (" + ISLANDS.format(t="n", rows=f"SELECT bucket_ns // {HOUR} AS n, tags FROM h") + ")")
def islands_bucketed(spark, d):
    return text(build.islands(events(spark, d), HOUR, step=HOUR))


_COUNTS = f"""SELECT 'unmerged' AS mode, count(*) AS intervals FROM l UNION ALL SELECT 'neighbour_runs', count(*) FROM ({_NEIGHBOURS})
UNION ALL SELECT 'islands', count(*) FROM ({ISLANDS.format(t='ts_ns', rows='SELECT DISTINCT ts_ns, tags FROM l')}) UNION ALL SELECT 'bitmap', count(DISTINCT ts_ns) FROM l"""


@registered(_COUNTS)
def interval_counts(spark, d):
    return stats.interval_counts(ship_days(spark, d))


@registered(f"SELECT p AS points, i AS intervals, p / i AS ratio FROM (SELECT count(*) AS p FROM l), (SELECT count(*) AS i FROM ({ISLANDS.format(t='ts_ns', rows='SELECT DISTINCT ts_ns, tags FROM l')}))")
def compression_ratio(spark, d):
    return stats.compression_ratio(ship_days(spark, d))


@registered(f"SELECT resolution_ns, count(*) AS islands, count(DISTINCT b) AS buckets, count(*) / count(DISTINCT b) AS reduction FROM (SELECT DISTINCT r AS resolution_ns, ts_ns // r * r AS b, tags FROM e, (SELECT unnest({RESOLUTIONS}) AS r)) GROUP BY resolution_ns")
def interval_scaling(spark, d):
    return stats.interval_scaling(events(spark, d, "event_type", "user_id"), RESOLUTIONS)


@registered(UNION.format(rows='SELECT "start" AS s, stop AS e, o_orderpriority AS tags FROM iv JOIN orders ON id = o_orderkey'))
def merge_value_aware(spark, d):
    own = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tags"))
    return build.merge_intervals(ship_intervals(spark, d).join(own, "id").select(F.col("start").alias("start_ns"), F.col("stop").alias("stop_ns"), "tags"))


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    p = order_points(spark, d)
    at = 900_000_000_000_000_000
    return p.where(F.col("ts_ns") < at), p.where(F.col("ts_ns") >= at - 30 * DAY)


_BOTH = f"(SELECT ts_ns, tags FROM o WHERE ts_ns < 900000000000000000 UNION ALL SELECT ts_ns, tags FROM o WHERE ts_ns >= {900_000_000_000_000_000 - 30 * DAY})"


@registered(f"SELECT DISTINCT ts_ns // {DAY} * {DAY} AS bucket_ns, tags FROM {_BOTH}")
def append_union(spark, d):
    old, more = _split(spark, d)
    return text(build.append_postings(build.postings(old, DAY), more, DAY))


@registered(f"SELECT DISTINCT ts_ns AS start_ns, ts_ns + 1 AS stop_ns, tags FROM {_BOTH}")
def append_islands(spark, d):
    old, more = _split(spark, d)
    return text(build.append_islands(build.islands(old), more))


@registered(f"SELECT ts_ns AS start_ns, ts_ns + 1 AS stop_ns, tags FROM {_BOTH}")
def append_unmerged(spark, d):
    old, more = _split(spark, d)
    return text(build.append_unmerged(build.unmerged(old), more))


# --- queries ---------------------------------------------------------------


def _event_rows(spark, d) -> tuple[DataFrame, Column]:
    return read(spark, d, "events"), tagset(["event_type", "user_id"])


@registered(f"SELECT DISTINCT tags FROM e WHERE ts_ns >= {POINT // HOUR * HOUR} AND ts_ns < {POINT // HOUR * HOUR + HOUR}")
def query_point(spark, d):
    df, tags = _event_rows(spark, d)
    lo = POINT - POINT % HOUR
    return text(query.in_range(df, lo, lo + HOUR, ts="ts").select(tags.alias("tags")).distinct())


@registered(f"SELECT DISTINCT tags FROM e WHERE ts_ns >= {LO // HOUR * HOUR} AND ts_ns < {-(-HI // HOUR) * HOUR}")
def query_range(spark, d):
    df, tags = _event_rows(spark, d)
    return text(query.in_range(df, LO, HI, HOUR, ts="ts").select(tags.alias("tags")).distinct())


@registered("SELECT DISTINCT tags FROM e")
def query_full_range(spark, d):
    return text(events(spark, d, "event_type", "user_id").select("tags").distinct())


@registered(f"SELECT tags FROM e WHERE ts_ns >= {POINT // HOUR * HOUR} AND ts_ns < {POINT // HOUR * HOUR + HOUR}")
def query_point_bag(spark, d):
    return text(query.query_point(events(spark, d, "event_type", "user_id"), POINT, HOUR, bag=True))


@registered(f"SELECT DISTINCT tags FROM h WHERE bucket_ns = {POINT // HOUR * HOUR}")
def query_point_islands(spark, d):
    return text(query.query_intervals_point(build.islands(events(spark, d), HOUR), POINT - POINT % HOUR))


@registered(f"SELECT DISTINCT tags FROM h WHERE bucket_ns >= {LO // HOUR * HOUR} AND bucket_ns < {-(-HI // HOUR) * HOUR}")
def query_range_islands(spark, d):
    return text(query.query_intervals(build.islands(events(spark, d), HOUR), LO - LO % HOUR, HI - HI % -HOUR))


@registered(f"SELECT DISTINCT probe_id, tags FROM asks JOIN h ON t // {HOUR} * {HOUR} = bucket_ns")
def query_points_batch(spark, d):
    probes = spark.range(1000).select(F.col("id").alias("probe_id"), (F.lit(JAN1) + F.col("id") * (29 * 60 * 10**9)).alias("t"))
    return text(query.query_points_batch(hourly(spark, d), probes, HOUR))


@registered(f"SELECT DISTINCT probe_id, tags FROM spans JOIN h ON bucket_ns >= lo // {HOUR} * {HOUR} AND bucket_ns < (hi + {HOUR - 1}) // {HOUR} * {HOUR}")
def query_ranges_batch(spark, d):
    lo = F.lit(JAN1) + F.col("id") * (5 * HOUR + 7 * 10**9)
    probes = spark.range(100).select(F.col("id").alias("probe_id"), lo.alias("lo"), (lo + F.col("id") % 9 * (11 * HOUR) + 10**9).alias("hi"))
    return text(query.query_ranges_batch(hourly(spark, d), probes, HOUR))


@registered(f"SELECT min(bucket_ns) AS min_ns, max(bucket_ns) + {HOUR} AS max_ns FROM h")
def index_bounds(spark, d):
    return query.bounds(hourly(spark, d), HOUR)


@registered("SELECT tags, dense_rank() OVER (ORDER BY tags) AS tagset_id FROM (SELECT DISTINCT tags FROM o)")
def tagset_dictionary(spark, d):
    return text(build.tagset_dictionary(order_points(spark, d)))


_STRINGS = "SELECT unnest(string_split(replace(tags, '=', ','), ',')) AS string FROM (SELECT DISTINCT tags FROM o)"


@registered(f"SELECT string, dense_rank() OVER (ORDER BY string) AS string_id FROM (SELECT DISTINCT string FROM ({_STRINGS}))")
def string_dictionary(spark, d):
    return build.string_dictionary(order_points(spark, d))


@registered(f"SELECT count(DISTINCT string) AS strings, (SELECT count(DISTINCT tags) FROM o) AS tagsets FROM ({_STRINGS})")
def dictionary_stats(spark, d):
    return stats.dictionary_stats(order_points(spark, d))


@registered(f"SELECT DISTINCT ts_ns // {DAY} * {DAY} AS bucket_ns, tags FROM o")
def decode_tagset(spark, d):
    p = order_points(spark, d)
    ids = build.tagset_dictionary(p)
    return text(build.decode(build.encode(build.postings(p, DAY), ids), ids)).select("bucket_ns", "tags")


# --- intervals -------------------------------------------------------------


def _probes(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(8).select(i.alias("q_id"), (8100 + i * 317).alias("q_start"), (8100 + i * 317 + i % 3 * 40).alias("q_stop"))


def _relation(name: str):
    def run(spark, d):
        return intervals.related(ship_intervals(spark, d), _probes(spark), name).select("id", "start", "stop", "q_id")

    run.__name__ = f"allen_{name}"
    on = intervals.RELATIONS[name]
    for short, column in (("xs", '"start"'), ("xe", "stop"), ("qs", "q_start"), ("qe", "q_stop")):
        on = on.replace(short, column)
    registered(f'SELECT id, "start", stop, q_id FROM iv JOIN probes ON {on}')(run)


def _relation_many(name: str):
    """As :func:`_relation`, for probes beyond the number that is broadcast; pairs
    are counted per probe."""

    def run(spark, d):
        i = F.col("id")
        probes = spark.range(400).select(i.alias("q_id"), (8000 + i * 7).alias("q_start"), (8000 + i * 7 + i % 11 * i % 90).alias("q_stop"))
        found = intervals.related(ship_intervals(spark, d), probes, name, few_probes=100)
        return found.groupBy("q_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("stop").alias("stops"))

    run.__name__ = f"allen_{name}_many"
    on = intervals.RELATIONS[name]
    for short, column in (("xs", '"start"'), ("xe", "stop"), ("qs", "q_start"), ("qe", "q_stop")):
        on = on.replace(short, column)
    many = "SELECT CAST(i AS BIGINT) AS q_id, CAST(8000 + i * 7 AS BIGINT) AS q_start, CAST(8000 + i * 7 + i % 11 * i % 90 AS BIGINT) AS q_stop FROM range(400) t(i)"
    registered(f'SELECT q_id, count(*) AS n, CAST(sum("start") AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS stops FROM iv JOIN ({many}) ON {on} GROUP BY q_id')(run)


for _name in intervals.RELATIONS:
    _relation(_name)
    _relation_many(_name)


@registered('SELECT a."start", a.stop, count(*) - 1 AS containers FROM (SELECT DISTINCT "start", stop FROM iv) a JOIN (SELECT DISTINCT "start", stop FROM iv) b ON b."start" <= a."start" AND b.stop >= a.stop GROUP BY a."start", a.stop')
def containment_pairs(spark, d):
    return intervals.containers(ship_intervals(spark, d))


@registered('SELECT DISTINCT unnest(["start", stop]) AS bound FROM iv')
def elementary_bounds(spark, d):
    return intervals.elementary_bounds(ship_intervals(spark, d))


@registered('SELECT "start", stop, max(id) AS id FROM iv GROUP BY "start", stop')
def interval_upsert(spark, d):
    return intervals.upsert(ship_intervals(spark, d), "id")


@registered('SELECT * FROM iv WHERE "start" = (SELECT min("start") FROM iv) AND stop = (SELECT max(stop) FROM iv WHERE "start" = (SELECT min("start") FROM iv))')
def interval_get(spark, d):
    rows = ship_intervals(spark, d)
    start, stop = rows.groupBy("start").agg(F.max("stop")).orderBy("start").first()
    return intervals.get(rows, start, stop)


def _keys(spark) -> DataFrame:
    return spark.range(8000, 11000).select(F.col("id").alias("start"), (F.col("id") + 30).alias("stop"))


@registered('SELECT DISTINCT i AS "start", i + 30 AS stop FROM range(8000, 11000) t(i) WHERE EXISTS (SELECT 1 FROM iv WHERE "start" = i AND stop = i + 30)')
def interval_exists(spark, d):
    return intervals.existing(_keys(spark), ship_intervals(spark, d))


@registered('SELECT * FROM iv WHERE NOT ("start" >= 8000 AND "start" < 11000 AND stop = "start" + 30)')
def interval_remove(spark, d):
    return intervals.remove(ship_intervals(spark, d), _keys(spark))


@registered("SELECT * FROM iv")
def interval_ordered(spark, d):
    return intervals.ordered(ship_intervals(spark, d))


@registered("SELECT bucket_ns, tags, 'a' AS only_in FROM h WHERE false")
def results_diff(spark, d):
    by_islands = build.islands(events(spark, d), HOUR).select(F.col("start_ns").alias("bucket_ns"), "tags")
    return stats.results_diff(text(hourly(spark, d)), text(by_islands))


@registered(f"SELECT *, 'a' AS only_in FROM (SELECT * FROM h EXCEPT SELECT ts_ns // {HOUR} * {HOUR}, kind FROM e WHERE ts_ns < {POINT})")
def results_diff_some(spark, d):
    early = events(spark, d).where(F.col("ts_ns") < POINT)
    return stats.results_diff(text(hourly(spark, d)), text(build.postings(early, HOUR)))


@registered(f"SELECT DISTINCT tags FROM h WHERE bucket_ns >= {LO // HOUR * HOUR} AND bucket_ns < {-(-HI // HOUR) * HOUR}")
def index_build_append(spark, d):
    """The index as an object: built in two parts, stored, read and asked."""
    p, folder = events(spark, d), f"{shared_root(spark)}/index-{uuid.uuid4().hex}"
    TagIndex.build(p.where(F.col("ts_ns") < POINT), HOUR).append(p.where(F.col("ts_ns") >= POINT), HOUR).write(folder)
    return text(TagIndex.read(spark, folder, HOUR).query_range(LO, HI))


@registered("SELECT count(*) AS rows, 0 AS inversions, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM e")
def sorted_points_order(spark, d):
    """That sorted points are in order: inversions by their position afterwards."""
    placed = points.sorted_rows(events(spark, d, "event_type", "user_id")).select("ts_ns", F.monotonically_increasing_id().alias("at"))
    return files.check_sorted(placed, "at", groups=1 << 33)


# --- streams ---------------------------------------------------------------


def _event_stream(spark, d) -> DataFrame:
    return points.extract_points(builds.read_stream(spark, f"{d}/events.parquet"), "ts", ["event_type"])


@registered("SELECT * FROM h")
def stream_postings(spark, d):
    return text(builds.stream_postings(_event_stream(spark, d), HOUR, shared_root(spark)))


@registered("SELECT bucket_ns AS start_ns, bucket_ns + 1 AS stop_ns, tags FROM h")
def stream_islands_foreachbatch(spark, d):
    return text(builds.stream_islands(_event_stream(spark, d), HOUR, shared_root(spark)))


@registered("SELECT count(*) AS points, 1 AS batches, count(DISTINCT kind) AS tagsets, max(ts_ns) AS max_ns, false AS out_of_order FROM e")
def stream_stats(spark, d):
    made = builds.ChunkedBuild(spark, HOUR, f"{shared_root(spark)}/chunked-{uuid.uuid4().hex}").run(_event_stream(spark, d)).stats.checked()
    return spark.createDataFrame([(made.points, made.batches, made.tagsets, made.max_ns, made.out_of_order)], "points long, batches int, tagsets long, max_ns long, out_of_order boolean")


@registered("SELECT bucket_ns AS start_ns, bucket_ns + 1 AS stop_ns, tags FROM h")
def stream_islands_stateful(spark, d):
    return text(builds.stream_islands_stateful(_event_stream(spark, d), HOUR, shared_root(spark)))
