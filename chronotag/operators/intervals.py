"""Relations between intervals, and a map keyed by interval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotag.plans.staging import stored

#: Fixed conditions on a stored interval [xs, xe) and a query [qs, qe).
RELATIONS = {
    "overlaps": "qe > xs AND qs < xe",
    "precedes": "xe < qs AND xs < qs",
    "preceded_by": "qs < xs AND qe < xs",
    "meets": "xe = qs",
    "met_by": "qe = xs",
    "starts": "xs = qs",
    "finishes": "xe = qe",
    "during": "xs >= qs AND xe <= qe",
    "contains": "xs <= qs AND xe >= qe",
}


def relation(name: str, xs: str, xe: str, qs: str, qe: str) -> Column:
    text = RELATIONS[name]
    for short, column in (("xs", xs), ("xe", xe), ("qs", qs), ("qe", qe)):
        text = text.replace(short, f"`{column}`")
    return F.expr(text)


#: Probes are broadcast up to this number.
FEW_PROBES = 10_000
#: Time cells in which pairs that precede each other meet, and rows of a side for
#: which the other side is copied once more.
ORDER_CELLS, SALT_ROWS, MOST_SALTS = 64, 5_000_000, 64
OVERLAPPING = ("overlaps", "during", "contains")


def related(intervals: DataFrame, probes: DataFrame, name: str, few_probes: int = FEW_PROBES) -> DataFrame:
    """Pairs of ``intervals`` (start, stop, ...) and ``probes`` (q_start, q_stop,
    ...) that are in a relation.

    Relations with an equality are equi-joins on the bound, overlapping ones go
    through :func:`overlap_join`.  For precedence, whose output is a share of all
    pairs by its nature, probes meet the time cells before (or after) them.
    Probes are counted first and broadcast if there are at most ``few_probes``.
    """
    on = relation(name, "start", "stop", "q_start", "q_stop")
    few = probes.limit(few_probes + 1).count() <= few_probes
    if name in OVERLAPPING:
        # closed: empty intervals count where they touch
        return overlap_join(intervals, probes, slack=0 if name == "overlaps" else 1, few=few).where(on)
    if name in ("precedes", "preceded_by"):
        return _ordered_pairs(intervals, probes, name == "precedes", few).where(on)
    return intervals.join(F.broadcast(probes) if few else probes, on)


def _ordered_pairs(intervals: DataFrame, probes: DataFrame, precedes: bool, few: bool) -> DataFrame:
    """Pairs that may precede each other: every interval with the probes of its
    own time cell and of all later (earlier) ones."""
    lo, hi = probes.agg(F.min("q_start"), F.max("q_stop")).first()
    if lo is None:
        return intervals.join(probes, F.lit(False))
    width = max(1, -(-(hi - lo + 1) // ORDER_CELLS))
    cell = lambda c: F.least(F.greatest(F.floor((F.col(c) - lo) / width), F.lit(0)), F.lit(ORDER_CELLS - 1)).cast("int")
    salts = 1 if few else max(1, min(MOST_SALTS, -(-intervals.count() // SALT_ROWS)))
    salt = F.pmod(F.xxhash64("start", "stop"), F.lit(salts)).cast("int")
    ends = F.sequence(cell("stop"), F.lit(ORDER_CELLS - 1)) if precedes else F.sequence(F.lit(0), cell("start"))
    left = intervals.withColumn("_cell", F.explode(ends)).withColumn("_salt", salt)
    right = probes.withColumn("_cell", cell("q_start" if precedes else "q_stop")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(F.broadcast(right) if few else right, ["_cell", "_salt"]).drop("_cell", "_salt")


def _levels(df: DataFrame, lo: str, hi: str) -> list[int]:
    """The sizes, as powers of two, that a table's intervals have: 64 at most."""
    return sorted(r[0] for r in df.select(_level(lo, hi)).distinct().collect())


def _level(lo: str, hi: str) -> Column:
    return F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(1)).cast("double"))).cast("int")


def overlap_join(left: DataFrame, right: DataFrame, slack: int = 0, few: bool = False) -> DataFrame:
    """Pairs of overlapping (start, stop) and (q_start, q_stop).

    Cells have the size of the larger interval of a pair, rounded up to a power
    of two, so an interval touches two cells, or three by rounding, of each size
    that it may be met at, however long it is.  A pair is kept in the first cell
    that both touch.  Where a side is large, a cell's short intervals are dealt
    to copies of its long ones, so one long interval does not gather all others
    in one task.  ``few``: the right side is broadcast.  ``slack`` 1 also gives
    pairs that only touch.
    """
    sizes = sorted({*_levels(left, "start", "stop"), *_levels(right, "q_start", "q_stop")})
    salts = 1 if few else max(1, min(MOST_SALTS, -(-left.count() // SALT_ROWS)))

    def spread(df: DataFrame, lo: str, hi: str, side: str) -> DataFrame:
        at = lambda c: F.expr(f"shiftright(cast({c} as bigint), _size)")
        out = df.withColumn(f"_own_{side}", _level(lo, hi)).withColumn("_size", F.explode(F.filter(F.array(*(F.lit(s) for s in sizes)), lambda s: s >= F.col(f"_own_{side}"))))
        out = out.withColumn(f"_first_{side}", at(lo)).withColumn("_cell", F.explode(F.sequence(F.col(f"_first_{side}"), F.greatest(F.col(f"_first_{side}"), at(f"{hi} - 1 + {slack}")))))
        all_salts, one = F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.pmod(F.xxhash64(lo, hi), F.lit(salts)).cast("int"))
        long = F.col("_size") == F.col(f"_own_{side}")
        return out.withColumn("_salt", F.explode(F.when(long, all_salts).otherwise(one)))

    l, r = spread(left, "start", "stop", "l"), spread(right, "q_start", "q_stop", "r")
    pairs = l.join(F.broadcast(r) if few else r, ["_size", "_cell", "_salt"])
    hit = (F.col("start") < F.col("q_stop") + slack) & (F.col("q_start") < F.col("stop") + slack)
    once = (F.col("_size") == F.greatest("_own_l", "_own_r")) & (F.col("_cell") == F.greatest("_first_l", "_first_r"))
    once = once & ((F.col("_own_l") != F.col("_own_r")) | (F.col("_salt") == 0))  # both copied: once
    return pairs.where(once & hit).drop("_size", "_cell", "_salt", "_own_l", "_own_r", "_first_l", "_first_r")


#: Intervals that one task counts the containers of.
STRIP_ROWS = 1 << 20


def containers(intervals: DataFrame, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """(start, stop, containers): for each distinct interval how many other
    distinct ones contain it, that is, begin no later and end no earlier.

    Intervals lie in strips of starts and strips of stops.  Those of earlier
    start strips and later stop strips are counted by cells (prefix sums), those
    of the same start strip or stop strip within the strip, in sorted order; no
    pair is made.
    """
    own = stored(intervals.select("start", "stop").distinct(), "intervals")
    n, lo, hi, low, high = own.agg(F.count("*"), F.min("start"), F.max("start"), F.min("stop"), F.max("stop")).first()
    strips = max(1, -(-n // strip_rows))
    if not n:
        return own.withColumn("containers", F.lit(0).cast("long"))
    strip = lambda c, a, b: F.floor((F.col(c) - a) / max(1, -(-(b - a + 1) // strips))).cast("int")
    cells = own.withColumn("i", strip("start", lo, hi)).withColumn("j", strip("stop", low, high))

    def within(kind: str):
        def count(t: pa.Table) -> pa.Table:
            """Containers within a strip: all of a start strip, or those of a stop
            strip from earlier start strips."""
            start, stop, i = (t.column(c).to_numpy() for c in ("start", "stop", "i"))
            counts = _dominating(np.argsort(-stop, kind="stable"), i if kind == "j" else start, stop, kind == "j")
            return pa.table({"start": start, "stop": stop, "n": pa.array(counts, pa.int64())})

        return count

    same_i = cells.groupBy("i").applyInArrow(within("i"), "start long, stop long, n long")
    same_j = cells.groupBy("j").applyInArrow(within("j"), "start long, stop long, n long")
    grid = cells.groupBy("i", "j").agg(F.count("*").alias("m"))  # strips squared at most
    before = grid.alias("a").join(F.broadcast(grid.select(F.col("i").alias("x"), F.col("j").alias("y"), "m")).alias("b"), (F.col("x") < F.col("a.i")) & (F.col("y") > F.col("a.j")), "left")
    before = before.groupBy("a.i", "a.j").agg(F.coalesce(F.sum("b.m"), F.lit(0)).alias("n"))
    far = cells.join(F.broadcast(before), ["i", "j"]).select("start", "stop", "n")
    return same_i.union(same_j).union(far).groupBy("start", "stop").agg((F.sum("n") - 1).cast("long").alias("containers"))


def _dominating(order: np.ndarray, first: np.ndarray, stop: np.ndarray, strictly: bool) -> np.ndarray:
    """For each row how many rows have a stop no less and a ``first`` no greater
    (less, if ``strictly``), itself included unless strictly.  ``order`` is by
    falling stop."""
    level = np.unique(first, return_inverse=True)[1][order]
    ends = np.searchsorted(-stop[order], -stop[order], "right")  # rows of equal stop count for each other
    out = np.empty(len(order), np.int64)
    out[order] = _prefix_counts(level, ends, level - 1 if strictly else level)
    return out


def _prefix_counts(level: np.ndarray, ends: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each k the number of t < ends[k] with level[t] <= bound[k], bit by bit
    of the level (a wavelet matrix)."""
    n, out = len(level), np.zeros(len(ends), np.int64)
    bits = max(1, int(level.max()).bit_length()) if n else 0
    now, lo, hi = level, np.zeros(len(ends), np.int64), ends.astype(np.int64)
    alive, want = bound >= 0, np.maximum(bound, 0)
    for b in range(bits - 1, -1, -1):
        one = (now >> b) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        up = ((want >> b) & 1) == 1
        z_lo, z_hi = zeros[lo], zeros[hi]
        out += np.where(alive & up, z_hi - z_lo, 0)  # all below at this bit
        total = int(zeros[-1])
        lo, hi = np.where(up, total + lo - z_lo, z_lo), np.where(up, total + hi - z_hi, z_hi)
        now = now[np.argsort(one, kind="stable")]
    return out + np.where(alive, hi - lo, 0)  # those equal to the bound


def elementary_bounds(intervals: DataFrame) -> DataFrame:
    return intervals.select(F.explode(F.array("start", "stop")).alias("bound")).distinct()


def upsert(rows: DataFrame, order: str) -> DataFrame:
    """The last value, by ``order``, of each exact interval."""
    last = F.row_number().over(Window.partitionBy("start", "stop").orderBy(F.desc(order)))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def get(rows: DataFrame, start: int, stop: int) -> DataFrame:
    return rows.where((F.col("start") == start) & (F.col("stop") == stop))


def existing(keys: DataFrame, rows: DataFrame) -> DataFrame:
    return keys.join(rows, ["start", "stop"], "left_semi")


def remove(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, ["start", "stop"], "left_anti")


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("start", "stop")
