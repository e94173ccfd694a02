"""Postings as bitmaps: a row for each time bucket and 32,768 ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 32_768


def bitmaps(encoded: DataFrame) -> DataFrame:
    """(bucket_ns, bm_bucket, bm) of postings (bucket_ns, tagset_id); ids from 1."""
    return (
        encoded.withColumn("bm_bucket", F.bitmap_bucket_number("tagset_id"))
        .groupBy("bucket_ns", "bm_bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("tagset_id")).alias("bm"))
    )


def compact(parts: DataFrame) -> DataFrame:
    """Bitmaps of one bucket or'ed into one, as after an append."""
    return parts.groupBy("bucket_ns", "bm_bucket").agg(F.bitmap_or_agg("bm").alias("bm"))


def counts(parts: DataFrame) -> DataFrame:
    """Tag sets per bucket."""
    return parts.groupBy("bucket_ns").agg(F.sum(F.bitmap_count("bm")).cast("long").alias("tagsets"))


def ids(parts: DataFrame) -> DataFrame:
    """(bucket_ns, tagset_id) of bitmaps.

    A bitmap's bytes are looked at within its row; only bits that are set
    become rows.
    """
    byte = F.split(F.decode("bm", "ISO-8859-1"), "")
    held = F.filter(F.transform(byte, lambda c, i: F.struct(F.ascii(c).alias("b"), i.alias("i"))), lambda x: x["b"] != 0)
    bits = F.sequence(F.lit(0), F.lit(7))
    at = F.flatten(F.transform(held, lambda x: F.transform(F.filter(bits, lambda j: F.getbit(x["b"], j) == 1), lambda j: x["i"] * 8 + j)))
    return parts.select("bucket_ns", "bm_bucket", F.explode(at).alias("at")).select("bucket_ns", ((F.col("bm_bucket") - 1) * BITS + F.col("at") + 1).cast("long").alias("tagset_id"))


def any_of(parts: DataFrame) -> DataFrame:
    """The ids of all buckets together, as one bitmap per 32,768 ids."""
    return parts.groupBy("bm_bucket").agg(F.bitmap_or_agg("bm").alias("bm"))
