"""Time as BIGINT nanoseconds: bucketing, raw-column ranges, durations."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 604800 * 10**9}
HOUR, DAY = NS["h"], NS["d"]
#: Spellings of the duration units, besides the short ones.
UNIT_NAMES = {
    "nanosecond": "ns", "nanos": "ns", "nsec": "ns", "microsecond": "us", "micros": "us", "usec": "us", "millisecond": "ms", "millis": "ms", "msec": "ms",
    "second": "s", "sec": "s", "minute": "m", "min": "m", "hour": "h", "hr": "h", "day": "d", "week": "w",
}


def nanos(c: Column, kind: T.DataType) -> Column:
    """A time column as nanoseconds since the epoch, whatever the session zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) * 1000
    if isinstance(kind, T.TimestampNTZType):
        day = F.datediff(c.cast("date"), F.lit(dt.date(1970, 1, 1))).cast("long") * DAY
        within = F.hour(c).cast("long") * HOUR + F.minute(c).cast("long") * NS["m"]
        return day + within + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long") * 1000
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit(dt.date(1970, 1, 1))).cast("long") * DAY
    return c.cast("long")


def raw_range(c: Column, kind: T.DataType, lo: int, hi: int) -> Column:
    """``lo <= nanos(c) < hi`` on the stored column, so that it reaches the scan."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        name = "TIMESTAMP_NTZ" if isinstance(kind, T.TimestampNTZType) else "TIMESTAMP"
        zone = "" if name == "TIMESTAMP_NTZ" else "+00:00"
        at = lambda ns: F.expr(f"{name}'{dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=-(-ns // 1000))}{zone}'")
        return (c >= at(lo)) & (c < at(hi))
    return (c >= lo) & (c < hi)


def bucket(ts: Column, resolution_ns: int) -> Column:
    """Floor to the resolution; one of 1 ns and less changes nothing."""
    return ts if resolution_ns <= 1 else ts - F.pmod(ts, F.lit(resolution_ns))


def floor_ns(t: int, resolution_ns: int) -> int:
    return t if resolution_ns <= 1 else t - t % resolution_ns


def ceil_ns(t: int, resolution_ns: int) -> int:
    return t if resolution_ns <= 1 else -(-t // resolution_ns) * resolution_ns


def parse_duration(text: str) -> int | None:
    """Nanoseconds of ``15m``, ``1 hour`` or ``250`` (ns); None if unreadable."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not m:
        return None
    unit = m[2].lower()
    unit = unit if unit in NS else UNIT_NAMES.get(unit.removesuffix("s")) or UNIT_NAMES.get(unit)
    return int(m[1]) * NS[unit] if unit else int(m[1]) if not m[2] else None


def format_duration(ns: int) -> str:
    """``1w 2d 3h`` and so on, largest unit first, what is below a second in ns;
    ``0ns`` for nothing."""
    out = []
    for unit in ("w", "d", "h", "m", "s", "ns"):
        n, ns = divmod(ns, NS[unit])
        if n:
            out.append(f"{n}{unit}")
    return " ".join(out) or "0ns"


def format_bytes(n: int) -> str:
    for unit in ("B", "KiB", "MiB"):
        if n < 1024:
            return f"{n} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} GiB"


def format_elapsed(seconds: float) -> str:
    for unit, scale in (("s", 1), ("ms", 1e3), ("µs", 1e6)):
        if seconds * scale >= 1:
            return f"{seconds * scale:.2f} {unit}"
    return f"{seconds * 1e9:.0f} ns"


def parse_cardinality(text: str) -> int:
    """``10K`` and ``1.5M`` as numbers."""
    scale = {"K": 1_000, "M": 1_000_000}.get(text.strip()[-1:].upper(), 1)
    return int(float(text.strip().rstrip("kKmM")) * scale)
