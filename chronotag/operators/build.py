"""Index builds from points (ts_ns, tags).

Four families hold the same tag sets at every instant and differ in how many
intervals they keep: one per point, runs of neighbours, islands per tag set,
or one entry per time bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotag.functions.tags import tagset
from chronotag.functions.timeutil import bucket
from chronotag.plans.staging import stored


def postings(points: DataFrame, resolution_ns: int, prebucketed: bool = False) -> DataFrame:
    """(bucket_ns, tags), each once: which tag sets each bucket holds.

    One partial and one final aggregate; rows meet after duplicates within a
    task are gone.
    """
    at = F.col("ts_ns") if prebucketed else bucket(F.col("ts_ns"), resolution_ns)
    return points.select(at.alias("bucket_ns"), "tags").distinct()


#: The last instant that has no interval [t, t+1).
LAST_NS = (1 << 63) - 1
OVERFLOW = "cannot make an interval [t, t+1) of the last instant"


def unmerged(points: DataFrame) -> DataFrame:
    """[t, t+1) for every point, repeats included; the last instant that a long
    holds fails with OVERFLOW."""
    stop = F.when(F.col("ts_ns") == LAST_NS, F.raise_error(F.lit(OVERFLOW)).cast("long")).otherwise(F.col("ts_ns") + 1)
    return points.select(F.col("ts_ns").alias("start_ns"), stop.alias("stop_ns"), "tags")


#: Rows that one time range holds on average, and time ranges at most.
RANGE_ROWS, MOST_RANGES = 1_000_000, 1 << 20


def _range_width(rows: DataFrame, at: str) -> int:
    """The width of time ranges that hold about RANGE_ROWS rows each; 0 if one
    range is enough for all."""
    lo, hi, n = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS)))
    return 0 if ranges == 1 else max(1, -(-(hi - lo + 1) // ranges))


def _range(at: str, width: int) -> Column:
    """The number of a row's time range; all are in one if ``width`` is 0."""
    return (F.floor(F.col(at) / width) if width else F.lit(0)).cast("long").alias("_range")


def merge_intervals(intervals: DataFrame, *value: str, start: str = "start_ns", stop: str = "stop_ns", width: int | None = None) -> DataFrame:
    """Per value the union of intervals that overlap or touch.

    A value's intervals are dealt to time ranges by their start and merged
    within each range, so a value with nearly all rows is spread over as many
    tasks as it has ranges.  One row for each value and range then carries the
    latest stop and the last run's start over to the ranges that follow.
    """
    value = value or ("tags",)
    width = _range_width(intervals, start) if width is None else width
    key = [*value, "_range"]
    dealt = intervals.select(*value, start, stop, _range(start, width))
    order = Window.partitionBy(*key).orderBy(start, stop)
    before = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = dealt.withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*key, "_run").agg(F.min(start).alias(start), F.max(stop).alias(stop))
    if not width:
        return runs.select(start, stop, *value)

    earlier = Window.partitionBy(*value).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda df, c: df.select(*(F.col(k).alias(f"_c{i}") for i, k in enumerate(key)), F.max(c).over(earlier).alias(f"_{c}"))
    on = lambda df: [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(key)]
    names = [f"_c{i}" for i in range(len(key))]
    latest = carried(runs.groupBy(*key).agg(F.max(stop).alias("latest")), "latest")
    fresh = runs.join(latest, on(latest)).drop(*names).withColumn("_head", F.when((F.col(start) <= F.col("_latest")), None).otherwise(F.col(start)))
    heads = carried(fresh.groupBy(*key).agg(F.max("_head").alias("head")).withColumnRenamed("head", "last"), "last")
    own = Window.partitionBy(*key).orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    led = fresh.join(heads, on(heads)).drop(*names).withColumn("_head", F.coalesce(F.max("_head").over(own), F.col("_last")))
    return led.groupBy(*value, "_head").agg(F.max(stop).alias(stop)).select(F.col("_head").alias(start), stop, *value)


def islands(points: DataFrame, resolution_ns: int = 1, step: int = 1, width: int | None = None) -> DataFrame:
    """Per tag set the maximal runs of buckets ``step`` apart, as intervals
    [first, last + step).

    With the default step buckets of more than 1 ns never touch, so each stays
    an interval of its own; ``step=resolution_ns`` joins neighbouring buckets.
    Runs are found within time ranges; only a range's first and last run of a
    tag set can go on in another range, and only these are merged further.
    """
    rows = postings(points, resolution_ns)
    if step < resolution_ns:
        return rows.select(F.col("bucket_ns").alias("start_ns"), (F.col("bucket_ns") + step).alias("stop_ns"), "tags")
    width = _range_width(points, "ts_ns") if width is None else width
    key = ["tags", "_range"]
    dealt = rows.select("bucket_ns", "tags", _range("bucket_ns", width))
    own = Window.partitionBy(*key).orderBy("bucket_ns")
    runs = (
        dealt.withColumn("_run", F.col("bucket_ns") - F.row_number().over(own) * step)
        .groupBy(*key, "_run")
        .agg(F.min("bucket_ns").alias("start_ns"), (F.max("bucket_ns") + step).alias("stop_ns"))
    )
    if not width:
        return runs.select("start_ns", "stop_ns", "tags")
    edge = Window.partitionBy(*key)
    marked = runs.withColumn("_edge", (F.col("start_ns") == F.min("start_ns").over(edge)) | (F.col("stop_ns") == F.max("stop_ns").over(edge)))
    out = ["start_ns", "stop_ns", "tags"]
    ends = marked.where("_edge").select(*out, "_range")
    by_tags = Window.partitionBy("tags").orderBy("start_ns")  # two rows a range at most
    joined = ends.withColumn("_new", F.when(F.lag("stop_ns").over(by_tags) == F.col("start_ns"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by_tags))
    joined = joined.groupBy("tags", "_run").agg(F.min("start_ns").alias("start_ns"), F.max("stop_ns").alias("stop_ns"))
    return marked.where(~F.col("_edge")).select(out).union(joined.select(out))


def neighbour_runs(points: DataFrame) -> DataFrame:
    """Runs that only neighbours in (time, tags) order extend.

    A tag set goes on from t-1 to t if it is the last of t-1 and the first of t.
    There is at most one such tag set for each instant, so the instants' first
    and last tag sets tell all continuations, and their islands the runs; every
    join is on the time, or on tag set and time.
    """
    rows = points.select("ts_ns", "tags").distinct()
    instants = points.groupBy("ts_ns").agg(F.min("tags").alias("tags"), F.max("tags").alias("last"))
    before = instants.select((F.col("ts_ns") + 1).alias("ts_ns"), F.col("last").alias("tags"))
    going_on = instants.select("ts_ns", "tags").join(before, ["ts_ns", "tags"], "left_semi")
    runs = islands(going_on, width=_range_width(points, "ts_ns")).select((F.col("start_ns") - 1).alias("ts_ns"), "stop_ns", "tags")
    starts = rows.join(going_on, ["ts_ns", "tags"], "left_anti")
    return starts.join(runs, ["ts_ns", "tags"], "left").select(F.col("ts_ns").alias("start_ns"), F.coalesce("stop_ns", F.col("ts_ns") + 1).alias("stop_ns"), "tags")


def append_postings(old: DataFrame, more: DataFrame, resolution_ns: int) -> DataFrame:
    """A bucket on both sides is one bucket."""
    return old.unionByName(postings(more, resolution_ns)).distinct()


def append_islands(old: DataFrame, more: DataFrame, resolution_ns: int = 1) -> DataFrame:
    """Only intervals of the appended tag sets that reach into the appended
    time are merged again; all others are passed on."""
    new = islands(more, resolution_ns)
    lo, hi = new.agg(F.min("start_ns"), F.max("stop_ns")).first()
    if lo is None:
        return old.select("start_ns", "stop_ns", "tags")
    near = (F.col("stop_ns") >= lo) & (F.col("start_ns") <= hi)
    touched = new.select("tags").distinct()
    out = ["start_ns", "stop_ns", "tags"]
    again = old.where(near).join(touched, "tags", "left_semi").select(out)
    same = old.where(~near).select(out).union(old.where(near).join(touched, "tags", "left_anti").select(out))
    return same.union(merge_intervals(again.union(new.select(out))))


def append_unmerged(old: DataFrame, more: DataFrame) -> DataFrame:
    return old.unionByName(unmerged(more))


#: Tag sets that are numbered in a single task, at most.
SMALL_DICTIONARY = 1_000_000


def numbered(values: DataFrame, id_col: str, *order: str) -> DataFrame:
    """Distinct rows with dense ids from 1 in the stated order.

    A large set is sorted into ranges and each range numbered from the count of
    those before it; only ranges' counts meet in one task.
    """
    values = values.select(*order).distinct()
    if values.limit(SMALL_DICTIONARY + 1).count() <= SMALL_DICTIONARY:
        return values.withColumn(id_col, F.row_number().over(Window.orderBy(*order)).cast("long"))
    # ranges are sampled anew in every run, so they are written once
    ranged = stored(values.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(id_col, (F.col("_before") + own).cast("long")).select(*order, id_col)


def tagset_dictionary(points: DataFrame) -> DataFrame:
    """(tags, tagset_id), ids dense from 1 in tag order."""
    return numbered(points, "tagset_id", "tags")


def string_dictionary(points: DataFrame) -> DataFrame:
    """(string, string_id) of all keys and values."""
    strings = points.select("tags").distinct().select(F.explode(F.flatten(F.transform("tags", lambda p: F.array(p["key"], p["value"])))).alias("string"))
    return numbered(strings, "string_id", "string")


def tagset_id(columns: list[str]) -> Column:
    """The 64-bit hash of a row's tag set from its tag columns; nulls are empty."""
    return F.xxhash64(*(x for c in sorted(columns) for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))))


def hashed_postings(rows: DataFrame, time: str, columns: list[str], resolution_ns: int, prebucketed: bool = False) -> DataFrame:
    """(bucket_ns, tagset_id) with a tag set's 64-bit hash as its id.

    Ids need no dictionary first, stay the same across appends and streams, and
    two longs are all that is shuffled.
    """
    at = F.col(time) if prebucketed else bucket(F.col(time), resolution_ns)
    return rows.select(at.alias("bucket_ns"), tagset_id(columns).alias("tagset_id")).distinct()


#: Rows whose tag sets are made distinct at once, without looking for first times.
DIRECT_ROWS = 4_000_000
#: Different first times that are looked for in the scan, and first rows that
#: are broadcast (two longs each), at most.
FIRST_TIMES, FIRST_ROWS = 10_000, 2_000_000


def hashed_dictionary(rows: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """(tagset_id, tags) for hashed ids; of tag sets whose hashes collide in
    their first time all stay, so that :func:`collisions` shows them.

    Only the rows of each id's first time are read with their tags; where these
    times are few, the scan skips all others.
    """
    if rows.count() <= DIRECT_ROWS:  # of Parquet, told by the footers
        return rows.select(tagset_id(columns).alias("tagset_id"), *columns).distinct().select("tagset_id", tagset(columns).alias("tags"))
    ids = rows.select(F.col(time).alias("_at"), tagset_id(columns).alias("tagset_id"))
    first = stored(ids.groupBy("tagset_id").agg(F.min("_at").alias("_at")), "first-times")
    n = first.count()
    times = [r[0] for r in first.select("_at").distinct().limit(FIRST_TIMES + 1).collect()]
    wide = rows.where(F.col(time).isin(times)) if len(times) <= FIRST_TIMES else rows
    wide = wide.select(F.col(time).alias("_at"), tagset_id(columns).alias("tagset_id"), *columns)
    found = wide.join(F.broadcast(first) if n <= FIRST_ROWS else first, ["tagset_id", "_at"], "left_semi").drop("_at").distinct()
    return found.select("tagset_id", tagset(columns).alias("tags"))


def collisions(dictionary: DataFrame) -> DataFrame:
    """Ids that stand for several tag sets; use dense ids if there are any."""
    return dictionary.groupBy("tagset_id").count().where("count > 1")


def encode(points: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Points with tagset_id for tags."""
    return points.join(dictionary, "tags").drop("tags")


def decode(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ids back to tags; an unknown id has none."""
    return encoded.join(dictionary, "tagset_id", "left").withColumn("tags", F.coalesce("tags", F.expr("cast(array() as array<struct<key:string,value:string>>)")))
