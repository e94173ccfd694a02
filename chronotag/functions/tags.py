"""Tag sets as arrays of (key, value) pairs, sorted by key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = "array<struct<key:string,value:string>>"
#: What a null tag becomes: the text "null", the empty text, or no pair.
NULL_POLICIES = ("literal", "empty", "omit")


def tagset(columns: list[str], null_policy: str = "empty") -> Column:
    """The tag set of a row.  Keys are sorted, so column order does not matter."""
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}")
    if not columns:
        return F.expr(f"cast(array() as {TAGS})")
    stand_in = {"literal": "null", "empty": "", "omit": None}[null_policy]
    value = lambda c: F.col(c).cast("string") if stand_in is None else F.coalesce(F.col(c).cast("string"), F.lit(stand_in))
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in sorted(columns)))
    return F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")) if null_policy == "omit" else pairs


def project(tags: Column, keys: list[str]) -> Column:
    return F.filter(tags, lambda p: p["key"].isin(keys))


def row_text(tags: Column) -> Column:
    """``k=v,k=v`` of all pairs."""
    return F.array_join(F.transform(tags, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")


def series_key(tags: Column) -> Column:
    """As :func:`row_text`, without pairs that have no value."""
    return row_text(F.filter(tags, lambda p: p["value"] != ""))
