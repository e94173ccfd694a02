import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotag import cli
from chronotag.functions import timeutil as t
from chronotag.functions.tags import row_text, series_key, tagset
from chronotag.operators import build
from chronotag.plans.index import NoData, ResolutionMismatch, TagIndex
from chronotag.sources import files, generator, lineprotocol, load, points
from chronotag.streaming import builds


@pytest.mark.parametrize(("text", "ns"), [("15m", 900 * 10**9), ("1h", 3600 * 10**9), ("2 days", 2 * t.DAY), ("250", 250), ("10us", 10_000), ("3 parsecs", None), ("", None), ("1w", 7 * t.DAY), ("5 seconds", 5 * 10**9), ("7nsec", 7), ("7 usec", 7_000)])
def test_parse_duration(text, ns):
    assert t.parse_duration(text) == ns


def test_formats():
    assert t.format_duration(8 * t.DAY + 3 * t.HOUR) == "1w 1d 3h"
    assert t.format_duration(0) == "0ns" and t.format_duration(2 * t.HOUR + 1_500_000) == "2h 1500000ns"
    assert (t.format_bytes(512), t.format_bytes(2048), t.format_bytes(3 << 30)) == ("512 B", "2.00 KiB", "3.00 GiB")
    assert t.format_elapsed(0.002) == "2.00 ms"
    assert (t.parse_cardinality("10K"), t.parse_cardinality("1.5M"), t.parse_cardinality("7")) == (10_000, 1_500_000, 7)


def test_floor_and_ceil():
    assert (t.floor_ns(25, 10), t.ceil_ns(25, 10), t.ceil_ns(20, 10), t.floor_ns(-7, 3), t.ceil_ns(7, 1)) == (20, 30, 20, -9, 7)


def test_bucket_floors_before_the_epoch(spark):
    df = spark.createDataFrame([(-7,), (0,), (25,)], "ts long")
    assert [r[0] for r in df.select(t.bucket(F.col("ts"), 10)).collect()] == [-10, 0, 20]


def test_nanos_does_not_depend_on_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.123456' AS x").select(t.nanos(F.col("x"), T.TimestampNTZType())).first()[0] == 1_710_037_800_123_456_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_null_policies_and_column_order(spark):
    df = spark.createDataFrame([(1, "x", None)], "time long, b string, a string")
    text = lambda policy: df.select(row_text(tagset(["b", "a"], policy))).first()[0]
    assert (text("literal"), text("empty"), text("omit")) == ("a=null,b=x", "a=,b=x", "b=x")
    assert df.select(series_key(tagset(["a", "b"]))).first()[0] == "b=x"
    with pytest.raises(ValueError):
        tagset(["a"], "other")


def test_roles():
    s = lambda *names, kind=T.StringType(): [T.StructField(n, kind) for n in names]
    schema = T.StructType([*s("Time", kind=T.LongType()), *s("host", "region"), *s("v", kind=T.DoubleType())])
    assert points.infer_roles(schema) == points.Roles("Time", ("host", "region"))
    marked = {"Time": points.TIME_ROLE, "host": points.TAG_ROLE}
    assert points.infer_roles(schema, marked).tags == ("host",)
    with pytest.raises(ValueError):
        points.infer_roles(T.StructType(s("host")))


def test_null_times_are_dropped(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "time long, host string")
    assert points.extract_points(df).count() == 1


def test_parquet_roles_and_nanoseconds(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    field = pa.field("at", pa.timestamp("ns"), metadata={points.ROLE_KEY: points.TIME_ROLE})
    pq.write_table(pa.table({"at": pa.array([1_500], pa.timestamp("ns"))}, schema=pa.schema([field])), tmp_path / "x.parquet")
    assert points.parquet_roles(str(tmp_path / "x.parquet")) == {"at": points.TIME_ROLE}
    path = str(tmp_path / "x.parquet")
    with pytest.raises(ValueError, match="nanosAsLong"):
        points.read_parquet(spark, path)
    spark.conf.set(points.NANOS_AS_LONG, "true")
    try:
        assert points.read_parquet(spark, path).first()[0] == 1_500
    finally:
        spark.conf.unset(points.NANOS_AS_LONG)
    assert files.footers(spark, path, "at") == [files.Footer(f"file:{path}", 1, 1_500, 1_500)]


def test_line_protocol(spark):
    lines = ["m,k=v,a=b f=1 5", "", "# note", "m f=1 7", "m,k=v 5", "m,k=v f=1 x", "  m,k=a=b f=1,g=2 9 "]
    got = lineprotocol.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.ts_ns, row) for r, row in ((r, ",".join(f"{p.key}={p.value}" for p in r.tags)) for r in got.collect())) == [
        (5, "_measurement=m,a=b,k=v"), (7, "_measurement=m"), (9, "_measurement=m,k=a=b"),
    ]


def test_generator(spark):
    assert generator.factorize(8) == [2, 2, 2, 1, 1, 1, 1, 1]
    for total in (1, 2, 60, 101, 1000, 1_000_000, 999_983):
        for columns in (1, 3, 8):
            assert math.prod(generator.factorize(total, columns)) == total and len(generator.factorize(total, columns)) == columns
    assert generator.factorize(60, 3) == [5, 4, 3] and max(generator.factorize(1_000_000)) == 8
    name = lambda i: spark.range(1).select(generator.tag_value(F.lit(i).cast("long"))).first()[0]
    assert [name(i) for i in (0, 25, 26, 51, 52, 702)] == ["a", "z", "aa", "az", "ba", "t702"]
    third = spark.range(1, 3).select(*generator.tag_columns(F.col("id"), [2, 2, 2, 1, 1, 1, 1, 1])).collect()
    assert [tuple(r)[:3] for r in third] == [("a", "a", "b"), ("a", "b", "a")]
    made = generator.generate_points(spark, 10, points=5)
    assert made.count() == 50 and made.drop("time").distinct().count() == 10


def test_config_and_kinds():
    got = files.LoadConfig.from_env({"LOAD_PATH": "x", "LOAD_MAX_ROWS": "5", "LOAD_MAX_DURATION": "2h", "LOAD_KIND": "LP", "LOAD_STREAM": "true", "LOAD_MAX_CARDINALITY": "many"})
    assert (got.path, got.max_rows, got.max_duration_ns, got.max_cardinality, got.kind, got.as_stream) == ("x", 5, 2 * t.HOUR, None, "lineprotocol", True)
    assert [files.input_kind("a.lp"), files.input_kind("a.parquet"), files.input_kind("d", ["x.lp"]), files.input_kind("d")] == ["lineprotocol", "parquet", "lineprotocol", "parquet"]


def test_check_sorted_over_stretches(spark):
    rows = spark.createDataFrame([(0, 1), (1, 3), (2, 2), (3, 4), (4, 3), (5, 9)], "i long, ts_ns long")
    assert tuple(files.check_sorted(rows, "i", groups=2).first()) == (6, 2, 1, 9)
    assert tuple(files.check_sorted(rows.limit(0), "i").first()) == (None, 0, None, None)


def test_limit_duration(spark):
    rows = spark.createDataFrame([(10,), (15,), (21,)], "ts_ns long")
    assert sorted(r[0] for r in files.limit_duration(rows, 10).collect()) == [10, 15]


@pytest.fixture
def folder(spark, tmp_path):
    """Files of a day each, days 0-3 and 6-7, the last unreadable; and a line file for each."""
    lines = tmp_path / "lines"
    lines.mkdir()
    for i, day in enumerate((0, 1, 2, 3, 6, 7)):
        rows = [(day * t.DAY + h * t.HOUR, "abc"[(h + i) % 3]) for h in range(24)]
        spark.createDataFrame(rows, "time long, host string").coalesce(1).write.parquet(str(tmp_path / f"day{i}"))
        (file,) = (tmp_path / f"day{i}").glob("*.parquet")
        (tmp_path / "days").mkdir(exist_ok=True)
        file.rename(tmp_path / "days" / f"{9 - i}.parquet")
        (lines / f"{i}.lp").write_text("".join(f"m,host={h} v=1 {at}\n" for at, h in reversed(rows)))
    (tmp_path / "days" / "0.parquet").write_bytes(b"PAR1 not a file")
    return tmp_path


def test_loads_choose_consecutive_files(spark, folder):
    days, lines = str(folder / "days"), str(folder / "lines")
    with pytest.raises(Exception, match="0.parquet"):
        files.footers(spark, days)
    found = files.footers(spark, days, skip_corrupt=True)
    assert [f.rows for f in found] == [24] * 6
    names = [f.file.rpartition("/")[2] for f in files.consecutive(found)]
    assert names == ["9.parquet", "8.parquet", "7.parquet", "6.parquet"]
    (folder / "days" / "0.parquet").unlink()
    config = files.LoadConfig(days)
    assert load.load(spark, config).count() == 96
    # the file that reaches the duration is still read
    assert load.load(spark, files.LoadConfig(days, max_duration_ns=30 * t.HOUR)).count() == 48
    got = [(r.ts_ns, r.tags[0].value) for r in load.load(spark, files.LoadConfig(days, max_rows=5)).collect()]
    assert got == [(h * t.HOUR, "abc"[h % 3]) for h in range(5)]
    few = load.load(spark, files.LoadConfig(days, max_cardinality=2, max_rows=7)).collect()
    assert [r.ts_ns // t.HOUR for r in few] == [0, 1, 3, 4, 6, 7, 9] and {r.tags[0].value for r in few} == {"a", "b"}
    assert load.load_rows(spark, files.LoadConfig(days, max_rows=100), "time").count() == 100
    assert load.load(spark, files.LoadConfig(days, as_stream=True)).isStreaming
    # line protocol: the same points with the measurement as a tag
    strip = lambda df: sorted((r.ts_ns, next(p.value for p in r.tags if p.key == "host")) for r in df.collect())
    assert strip(load.load(spark, files.LoadConfig(lines, max_duration_ns=30 * t.HOUR))) == strip(load.load(spark, files.LoadConfig(days, max_duration_ns=30 * t.HOUR)))
    in_order = [r.ts_ns for r in load.load(spark, files.LoadConfig(lines)).collect()]
    assert len(in_order) == 144 and in_order == sorted(in_order)
    with pytest.raises(FileNotFoundError):
        load.load_lines(spark, files.LoadConfig(days))


def test_command_line(spark, folder, capsys):
    (folder / "days" / "0.parquet").unlink()
    days = str(folder / "days")
    cli.main(["count", days], spark)
    cli.main(["check-sorted", days], spark)
    cli.main(["sort", days, str(folder / "sorted")], spark)
    cli.main(["generate", "10", str(folder / "made"), "--points", "5"], spark)
    cli.main(["compare", days, "40", "20"], spark)
    told = capsys.readouterr().out
    assert "total: 144 rows in 6 files" in told and told.count("sorted\n") >= 6 and f"144 rows in {folder}/sorted" in told and f"50 rows in {folder}/made" in told
    assert "all modes agree" in told and "bitmap: " in told


def test_stream_counters(spark, folder):
    (folder / "days" / "0.parquet").unlink()
    stream = points.extract_points(builds.read_stream(spark, str(folder / "days"), 2))
    made = builds.ChunkedBuild(spark, t.HOUR, str(folder / "chunks")).run(stream)
    whole = build.islands(points.extract_points(spark.read.parquet(str(folder / "days"))), t.HOUR)
    assert made.table().exceptAll(whole).count() == 0 and made.table().count() == whole.count() == 144
    assert (made.stats.points, made.stats.batches, made.stats.tagsets, made.stats.points_per_batch) == (144, 3, 3, 48.0)
    assert made.stats.seconds > 0 and made.stats.checked() is made.stats
    with pytest.raises(NoData):
        builds.StreamStats().checked()
    late = builds.StreamStats()
    batch = lambda *ts: spark.createDataFrame([(x,) for x in ts], "ts_ns long")
    assert [late.seen(batch(*b)) and late.out_of_order for b in ((3, 5), (5, 9), (8,))] == [False, False, True]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = [(at * t.HOUR, [("host", h)]) for at, h in ((1, "a"), (2, "a"), (3, "b"))]
    schema = "ts_ns long, tags array<struct<key:string,value:string>>"
    made = builds.ChunkedBuild(spark, 1, str(tmp_path / "x"))
    for number, part in ((0, rows[:2]), (1, rows[2:]), (1, rows[2:]), (2, rows), (2, rows), (3, [])):
        made.process(spark.createDataFrame(part, schema), number)
    want = build.islands(spark.createDataFrame(rows, schema))
    assert made.table().exceptAll(want).count() == 0 and made.table().count() == want.count()


def test_append_checks_the_resolution(spark):
    p = points.extract_points(spark.createDataFrame([(1, "a")], "time long, host string"))
    index = TagIndex.build(p, 10)
    assert index.append(p, 10).table.count() == 1
    with pytest.raises(ResolutionMismatch):
        index.append(p, 20)
