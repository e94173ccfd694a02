import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronotag.functions.timeutil import ceil_ns, floor_ns
from chronotag.operators import bitmaps, build, intervals, query, stats
from chronotag.plans.index import MODES, NoData, TagIndex

SCHEMA = "ts_ns long, tags array<struct<key:string,value:string>>"


def make(spark, rows):
    return spark.createDataFrame([(t, [("host", h)] if isinstance(h, str) else h) for t, h in rows], SCHEMA)


def hosts(df):
    return sorted(r.tags[0].value for r in df.collect())


def flat(df):
    return sorted((r.start_ns, r.stop_ns, r.tags[0].value) for r in df.collect())


@pytest.mark.parametrize("mode", MODES)
def test_points_and_ranges(spark, mode):
    index = TagIndex.build(make(spark, [(1, "a"), (2, "a"), (5, "b"), (6, "b"), (10, "c")]), 1, mode)
    assert [hosts(index.query_point(t)) for t in (1, 3, 5, 10)] == [["a"], [], ["b"], ["c"]]
    assert [hosts(index.query_range(*r)) for r in ((1, 6), (0, 1), (3, 5), (4, 4))] == [["a", "b"], [], [], []]
    assert hosts(index.query_full_range()) == ["a", "b", "c"] and index.bounds() == (1, 11)


@pytest.mark.parametrize("mode", MODES)
def test_empty(spark, mode):
    index = TagIndex.build(make(spark, []), 1, mode)
    assert (index.query_point(0).count(), index.query_range(0, 100).count(), index.interval_count()) == (0, 0, 0)
    with pytest.raises(NoData):
        index.bounds()


@pytest.mark.parametrize(("mode", "intervals_"), [("bitmap", 3), ("islands", 1), ("neighbour_runs", 1), ("unmerged", 3)])
def test_interval_counts_of_a_run(spark, mode, intervals_):
    assert TagIndex.build(make(spark, [(1, "a"), (2, "a"), (3, "a")]), 1, mode).interval_count() == intervals_


def test_families_differ_in_intervals_only(spark):
    p = make(spark, [(1, "a"), (1, "b"), (2, "a"), (2, "b")])
    got = {r["mode"]: r["intervals"] for r in stats.interval_counts(p).collect()}
    assert got == {"unmerged": 4, "neighbour_runs": 4, "islands": 2, "bitmap": 2}


def test_append(spark):
    old, more = make(spark, [(1, "s1"), (2, "s1")]), make(spark, [(3, "s1"), (5, "s2"), (2, "s1")])
    assert flat(TagIndex.build(old, 1, "islands").append(more).table) == [(1, 4, "s1"), (5, 6, "s2")]
    assert TagIndex.build(old).append(more).table.count() == 4
    for mode in MODES:
        assert hosts(TagIndex.build(old, 1, mode).append(more).query_point(2)) == ["s1"]


def test_resolution_and_unaligned_ranges(spark):
    index = TagIndex.build(make(spark, [(3, "a"), (14, "b"), (25, "c")]), 10)
    assert hosts(index.query_range(12, 25)) == ["b", "c"]
    assert hosts(index.query_range(10, 10)) == [] and hosts(index.query_range(5, 5)) == ["a"]
    assert index.bounds() == (0, 30)


def test_islands_of_buckets(spark):
    p = make(spark, [(3, "a"), (14, "a")])
    assert flat(build.islands(p, 10)) == [(0, 1, "a"), (10, 11, "a")]
    assert flat(build.islands(p, 10, step=10)) == [(0, 20, "a")]


def test_all_modes_agree_on_random_points(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-20, 60), rng.choice("abcd")) for _ in range(120)]
    for resolution in (1, 7):
        built = [TagIndex.build(make(spark, rows), resolution, m) for m in MODES]
        for lo, hi in ((-20, -5), (0, 13), (5, 5), (59, 80), (-100, 100)):
            want = sorted({h for t, h in rows if floor_ns(lo, resolution) <= t < ceil_ns(hi, resolution)})
            assert all(hosts(b.query_range(lo, hi)) == want for b in built), (resolution, lo, hi)


def test_batches_equal_single_queries(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(0, 3000), rng.choice("abcdefgh")) for _ in range(300)]
    index = TagIndex.build(make(spark, rows), 10)
    spans = [(i, a, a + rng.choice([0, 1, 7, 900, 2500])) for i, a in enumerate(rng.randrange(0, 2500) for _ in range(30))]
    got = query.query_ranges_batch(index.table, spark.createDataFrame(spans, "probe_id long, lo long, hi long"), 10, cell_buckets=8)
    got = {k: sorted(h for _, h in v) for k, v in itertools.groupby(sorted((r.probe_id, r.tags[0].value) for r in got.collect()), lambda x: x[0])}
    for i, lo, hi in spans:
        assert got.get(i, []) == sorted({h for t, h in rows if floor_ns(lo, 10) <= t < ceil_ns(hi, 10)})
    asks = index.query_points(spark.createDataFrame([(0, 5), (1, 2999)], "probe_id long, t long")).collect()
    assert sorted({r.tags[0].value for r in asks if r.probe_id == 0}) == sorted({h for t, h in rows if t < 10})


def test_merge_is_value_aware(spark):
    df = spark.createDataFrame([(1, 3, "v1"), (3, 5, "v1"), (5, 7, "v2"), (2, 3, "v1"), (9, 9, "v1")], "start_ns long, stop_ns long, tags string")
    assert sorted(map(tuple, build.merge_intervals(df).collect())) == [(1, 5, "v1"), (5, 7, "v2"), (9, 9, "v1")]


def test_neighbour_runs_equal_a_sequential_model(spark):
    rng = random.Random(9)
    rows = sorted({(rng.randrange(0, 25), rng.choice("abc")) for _ in range(60)})
    want, last = [], None
    for t, v in rows:
        if last and last[2] == v and last[1] == t:
            last[1] = t + 1
        else:
            last = [t, t + 1, v]
            want.append(last)
    assert flat(build.neighbour_runs(make(spark, rows))) == sorted(map(tuple, want))


def test_dictionaries_and_duplicate_keys(spark):
    p = make(spark, [(1, [("env", "prod"), ("host", "s1")]), (2, [("env", "dev"), ("host", "s2")]), (3, [("k", "1"), ("k", "2")])])
    assert tuple(stats.dictionary_stats(p).first()) == (9, 3)
    ids = build.tagset_dictionary(p)
    assert sorted(r.tagset_id for r in ids.collect()) == [1, 2, 3]
    back = build.decode(spark.createDataFrame([(1, 1), (2, 99)], "bucket_ns long, tagset_id long"), ids)
    assert {r.bucket_ns: len(r.tags) for r in back.collect()} == {1: 2, 2: 0}
    assert [len(r.tags) for r in ids.collect() if [x.key for x in r.tags] == ["k", "k"]] == [2]


def test_large_dictionary_numbers_by_range(spark, monkeypatch):
    monkeypatch.setattr(build, "SMALL_DICTIONARY", 10)
    got = build.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), "n", "x")
    assert sorted((r.x, r.n) for r in got.collect()) == [(i, i + 1) for i in range(1000)]


def test_bitmaps_round_trip(spark):
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(3), rng.choice([1, 2, 32768, 32769, 70000, rng.randrange(1, 99999)])) for _ in range(300)})
    maps = bitmaps.bitmaps(spark.createDataFrame(pairs, "bucket_ns long, tagset_id long"))
    assert sorted(map(tuple, bitmaps.ids(maps).collect())) == pairs
    assert sum(r.tagsets for r in bitmaps.counts(bitmaps.compact(maps.union(maps))).collect()) == len(pairs)
    assert bitmaps.any_of(maps).agg(F.sum(F.bitmap_count("bm"))).first()[0] == len({i for _, i in pairs})


@pytest.mark.parametrize("name", sorted(intervals.RELATIONS))
def test_relations(spark, name):
    rng = random.Random(name)
    own = sorted({tuple(sorted((rng.randrange(20), rng.randrange(20)))) for _ in range(40)})
    asked = sorted({tuple(sorted((rng.randrange(20), rng.randrange(20)))) for _ in range(12)})
    fn = {
        "overlaps": lambda x, q: q[1] > x[0] and q[0] < x[1], "precedes": lambda x, q: x[1] < q[0] and x[0] < q[0],
        "preceded_by": lambda x, q: q[0] < x[0] and q[1] < x[0], "meets": lambda x, q: x[1] == q[0], "met_by": lambda x, q: q[1] == x[0],
        "starts": lambda x, q: x[0] == q[0], "finishes": lambda x, q: x[1] == q[1],
        "during": lambda x, q: x[0] >= q[0] and x[1] <= q[1], "contains": lambda x, q: x[0] <= q[0] and x[1] >= q[1],
    }[name]
    want = sorted((*x, *q) for x in own for q in asked if fn(x, q))
    x, q = spark.createDataFrame(own, "start long, stop long"), spark.createDataFrame(asked, "q_start long, q_stop long")
    own += [(-500, 900), (0, 10**6)] if name == "overlaps" else []
    x = spark.createDataFrame(own, "start long, stop long")
    want = sorted((*x, *q) for x in own for q in asked if fn(x, q))
    for few in (10_000, 0):
        got = intervals.related(x, q, name, few).select("start", "stop", "q_start", "q_stop")
        assert sorted(map(tuple, got.collect())) == want, few


def test_salted_overlaps_and_containers(spark, monkeypatch):
    rng = random.Random(6)
    own = sorted({(a, a + rng.choice([0, 1, 3, 40, 900])) for a in (rng.randrange(-300, 300) for _ in range(150))})
    asked = sorted({(a, a + rng.choice([1, 5, 2000])) for a in (rng.randrange(-300, 300) for _ in range(60))})
    monkeypatch.setattr(intervals, "SALT_ROWS", 20)
    x, q = spark.createDataFrame(own, "start long, stop long"), spark.createDataFrame(asked, "q_start long, q_stop long")
    for name, fn in {"overlaps": lambda x, q: q[1] > x[0] and q[0] < x[1], "precedes": lambda x, q: x[1] < q[0] and x[0] < q[0]}.items():
        got = intervals.related(x, q, name, 0).select("start", "stop", "q_start", "q_stop")
        assert sorted(map(tuple, got.collect())) == sorted((*a, *b) for a in own for b in asked if fn(a, b)), name
    want = sorted((a, b, sum(c <= a and d >= b for c, d in own) - 1) for a, b in own)
    for rows in (1 << 20, 20):
        assert sorted(map(tuple, intervals.containers(x, rows).collect())) == want
    assert intervals.containers(x.limit(0)).count() == 0


def test_interval_map(spark):
    rows = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 2), (2, 3, "c", 3)], "start long, stop long, v string, seq long")
    now = intervals.upsert(rows, "seq")
    assert sorted(r.v for r in now.collect()) == ["b", "c"]
    assert intervals.get(now, 2, 3).first().v == "c"
    keys = spark.createDataFrame([(1, 5), (7, 8)], "start long, stop long")
    assert intervals.existing(keys, now).count() == 1 and [r.v for r in intervals.remove(now, keys).collect()] == ["c"]
    assert sorted(tuple(r) for r in intervals.containers(rows).collect()) == [(1, 5, 0), (2, 3, 1)]


def test_store(spark, tmp_path):
    index = TagIndex.build(make(spark, [(1, "a"), (10**15, "b")]), 10)
    index.write(str(tmp_path / "x"))
    again = TagIndex.read(spark, str(tmp_path / "x"), 10)
    assert hosts(again.query_range(0, 10)) == ["a"] and again.unique_tagsets() == 2 and again.size_bytes() > 0


def test_range_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = query.in_range(df, 1_704_067_200 * 10**9, 1_704_153_600 * 10**9, ts="ts").select("event_type").distinct()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text and "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text


def test_results_diff(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(map(tuple, stats.results_diff(a, b).collect())) == [(1, "a"), (2, "a"), (3, "b")]


def test_hashed_ids(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (12, "b", "x"), (13, "b", "x"), (14, "a", None)], "at long, host string, zone string")
    columns = ["zone", "host"]
    ids = build.hashed_dictionary(rows, "at", columns)
    assert ids.count() == 2 and build.collisions(ids).count() == 0
    back = build.hashed_postings(rows, "at", columns, 10).join(ids, "tagset_id")
    assert sorted((r.bucket_ns, [tuple(p) for p in r.tags]) for r in back.collect()) == [(0, [("host", "a"), ("zone", "")]), (10, [("host", "a"), ("zone", "")]), (10, [("host", "b"), ("zone", "x")])]
    assert build.collisions(ids.union(ids.select("tagset_id", "tags").limit(1))).count() == 1
    monkeypatch.setattr(build, "DIRECT_ROWS", 1)
    for few in (0, 10):
        monkeypatch.setattr(build, "FIRST_TIMES", few)
        assert sorted(map(tuple, build.hashed_dictionary(rows, "at", columns).collect())) == sorted(map(tuple, ids.collect()))


def test_ranges_do_not_show_in_unions(spark):
    rng = random.Random(4)
    rows = [(s, s + rng.choice([0, 1, 2, 9, 60]), rng.choice(["u", "v", None])) for s in (rng.randrange(-40, 200) for _ in range(250))]
    df = spark.createDataFrame(rows, "start_ns long, stop_ns long, tags string")
    want = []
    for v in ("u", "v", None):
        own = []
        for s, e in sorted((s, e) for s, e, x in rows if x == v):
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        want += [(s, e, v) for s, e in own]
    for width in (1, 7, 50, 10**6):
        assert sorted(map(tuple, build.merge_intervals(df, width=width).collect()), key=str) == sorted(want, key=str), width
    p = make(spark, [(rng.randrange(0, 120), rng.choice("ab")) for _ in range(150)])
    want = flat(build.islands(p, width=10**6))
    assert all(flat(build.islands(p, width=w)) == want for w in (1, 3, 40)) and build.islands(p.limit(0)).count() == 0


def test_one_hot_tag_set_is_dealt_by_time(spark, monkeypatch):
    monkeypatch.setattr(build, "RANGE_ROWS", 500)
    hot = spark.range(0, 20_000).select((F.col("id") * 2).alias("ts_ns"), F.expr("array(named_struct('key', 'host', 'value', 'a'))").alias("tags"))
    assert build._range_width(hot, "ts_ns") == 1000
    assert build.islands(hot).count() == 20_000 and build.neighbour_runs(hot).count() == 20_000


def test_the_last_instant_overflows(spark):
    assert build.unmerged(make(spark, [(build.LAST_NS - 1, "a")])).first().stop_ns == build.LAST_NS
    with pytest.raises(Exception, match="last instant"):
        build.unmerged(make(spark, [(build.LAST_NS, "a")])).collect()
