"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotag.llm.common import staged

#: A group of equal texts is heavy from this share of all bytes or rows on, so
#: at most twice as many groups are heavy, whatever the size of the corpus.
HEAVY_SHARES = 512


def byte_balanced_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut a global order of the documents at equal byte targets.

    The order has the few heavy groups of equal texts first (largest first),
    then all other texts by hash, so copies are neighbours and every cut but
    those among heavy groups falls between light ones.  Per-partition byte
    totals give each partition its global offset; a group goes whole to the
    shard that holds its midpoint.

    Size is the text's UTF-8 bytes plus 1; a null text is an empty one.  Repeated and null ids are kept as rows
    of their own, ordered by id and size, nulls first.  A text larger than a
    shard's share stays whole.  An empty table gives an empty result.  Other
    columns of ``docs``, whatever their names, are ignored.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 within a
    shard, in the global order) and grown_shard (always null for this law).
    """
    base = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")).alias("text_crc32"),
            F.md5(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")).alias("h"),
        ),
        "shard-base",
    )
    total, count = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    largest_first = Window.orderBy(F.desc("g_bytes"), "h")
    heavy = (
        base.groupBy("h")
        .agg(F.sum("size").alias("g_bytes"), F.count("*").alias("g_rows"))
        .where((F.col("g_bytes") * HEAVY_SHARES > total) | (F.col("g_rows") * HEAVY_SHARES > count))
        .withColumn("rank", F.row_number().over(largest_first))
        .withColumn("g_start", F.sum("g_bytes").over(largest_first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("g_bytes"))
        .drop("g_rows")
    )
    # heavy has at most 2 * HEAVY_SHARES rows by its definition
    tagged = base.join(F.broadcast(heavy), "h", "left").withColumn("o1", F.coalesce("rank", F.lit(4 * HEAVY_SHARES)))
    # rows of a light group share a partition; those of a heavy one may be dealt to many
    dealt = staged(
        tagged.withColumn("o3", F.when(F.col("rank").isNotNull(), F.col("doc_id")))
        .repartitionByRange("o1", "h", "o3")
        .withColumn("pid", F.spark_partition_id()),
        "shard-dealt",
    )
    by_pid = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row for each partition
        dealt.groupBy("pid")
        .agg(F.sum("size").alias("p_bytes"), F.count("*").alias("p_rows"))
        .select("pid", *(F.coalesce(F.sum(c).over(by_pid), F.lit(0)).alias(to) for c, to in (("p_bytes", "byte_at"), ("p_rows", "row_at"))))
    )
    order = Window.partitionBy("pid").orderBy("o1", "h", "doc_id", "size")
    group = Window.partitionBy("pid", "o1", "h")
    placed = (
        dealt.join(F.broadcast(offsets), "pid")
        .withColumn("row", F.col("row_at") + F.row_number().over(order) - 1)
        .withColumn("before", F.col("byte_at") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("start", F.coalesce("g_start", F.min("before").over(group)))
        .withColumn("bytes", F.coalesce("g_bytes", F.sum("size").over(group)))
    )
    if total:
        cut = F.floor((F.col("start") * 2 + F.col("bytes")).cast("decimal(38,0)") * n_shards / F.lit(2 * total).cast("decimal(38,0)"))
    else:
        cut = F.lit(0)
    placed = staged(placed.select("doc_id", "size", "text_crc32", F.least(cut, F.lit(n_shards - 1)).cast("int").alias("shard"), "row"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 by its table, which is made bit by bit.
_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, md5(coalesce(text, '')) AS h, hex(encode(coalesce(text, ''))) AS x FROM documents),
t AS MATERIALIZED (SELECT {_TABLE} AS crc),
sums AS (SELECT h, x, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM (SELECT DISTINCT h, x FROM d), t),
al AS (SELECT sum(size) AS total, count(*) AS n FROM d),
heavy AS (SELECT h, row_number() OVER (ORDER BY b DESC, h) AS rank FROM (SELECT h, sum(size) AS b, count(*) AS n FROM d GROUP BY h) g, al
  WHERE b * {HEAVY_SHARES} > total OR g.n * {HEAVY_SHARES} > al.n),
o AS (SELECT d.*, coalesce(rank, {4 * HEAVY_SHARES}) AS o1 FROM d LEFT JOIN heavy USING (h)),
p AS (SELECT doc_id, size, h, row_number() OVER w - 1 AS row, sum(size) OVER w - size AS before, sum(size) OVER (PARTITION BY o1, h) AS bytes, o1 FROM o
  WINDOW w AS (ORDER BY o1, h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT doc_id, size, h, row, CAST(least(7, (2 * min(before) OVER (PARTITION BY o1, h) + bytes) * 8 // (2 * (SELECT total FROM al))) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row - min(row) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN sums USING (h)
"""
