"""Synthetic points of a chosen cardinality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01 in ns; points 15 s apart, a day of them per tag set, eight tags.
START, STEP, POINTS, TAG_COLUMNS = 1_704_067_200_000_000_000, 15 * 10**9, 5760, 8


def prime_factors(n: int) -> list[int]:
    """Largest first."""
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return sorted(out + [n] * (n > 1), reverse=True)


def factorize(total: int, columns: int = TAG_COLUMNS) -> list[int]:
    """Values per column, largest first, with a product of exactly ``total``.

    Each prime factor goes to the column that has the fewest values so far.
    """
    out = [1] * columns
    for p in prime_factors(max(1, total)):
        out[out.index(min(out))] *= p
    return sorted(out, reverse=True)


def tag_value(i: Column) -> Column:
    """a to z, aa to zz, then t702, t703, ..."""
    letter = lambda n: F.chr((n + 97).cast("long"))
    j = i - 26
    return F.when(i < 26, letter(i)).when(i < 702, F.concat(letter(F.floor(j / 26)), letter(j % 26))).otherwise(F.concat(F.lit("t"), i.cast("string")))


def tag_columns(index: Column, cards: list[int]) -> list[Column]:
    """t0, t1, ...: the digits of a combination's index, last column fastest."""
    out, stride = [], 1
    for c, card in reversed(list(enumerate(cards))):
        out.append(tag_value(F.pmod(F.floor(index / stride).cast("long"), F.lit(card))).alias(f"t{c}"))
        stride *= card
    return out[::-1]


#: Rows that a slice of generated points holds.
SLICE_ROWS = 1_000_000


def generate_points(spark: SparkSession, cardinality: int, points: int = POINTS, step_ns: int = STEP, start_ns: int = START, columns: int = TAG_COLUMNS) -> DataFrame:
    """(time, t0...): every tag set at every step, in slices of bounded size."""
    cards, rows = factorize(cardinality, columns), cardinality * points
    slices = max(spark.sparkContext.defaultParallelism, -(-rows // SLICE_ROWS))
    made = spark.range(0, rows, numPartitions=slices)
    return made.select((F.lit(start_ns) + F.floor(F.col("id") / cardinality).cast("long") * step_ns).alias("time"), *tag_columns(F.col("id") % cardinality, cards))


def generate_prebucketed(spark: SparkSession, cardinality: int, buckets: int = 24, resolution_ns: int = 3600 * 10**9) -> DataFrame:
    return generate_points(spark, cardinality, buckets, resolution_ns)


def write_points(points: DataFrame, path: str) -> None:
    """Generated points as Parquet, a file for each slice."""
    points.write.mode("overwrite").parquet(path)
