"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.llm.common import HOT_SHARES, discard, staged


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is
    named by its smallest node.

    Alternating large-star and small-star steps: every step joins each node with
    the smallest node near it, and each round is written to the shared folder and
    the one before removed.  A component becomes a star, so its centre comes to
    have a share of all links: such hot nodes are joined by broadcast.  Null ends
    are no links; repeated links count once.
    """
    a, b = F.col("a"), F.col("b")
    edges = staged(links.where((a != b)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        stars = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), f"{name}-least")
        total = stars.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hot = [r[0] for r in stars.where(F.col("n") * HOT_SHARES > total).select("a").collect()]  # HOT_SHARES at most
        least = stars.drop("n")
        is_hot = a.isin(hot) if hot else F.lit(False)
        large = both.where(~is_hot).join(least, "a")
        if hot:
            large = large.union(both.where(is_hot).join(F.broadcast(least.where(is_hot)), "a"))
        large = large.where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))  # a node's smaller neighbours, few at the end
        small = large.join(m, "a").select(F.inline(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct(a.alias("a"), F.col("m").alias("b")))))
        last, edges = edges, staged(small.where(a != b).distinct(), name)
        discard(last, stars)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(a.alias("node"), b.alias("component")).union(edges.select(b.alias("node"), b.alias("component")).distinct())
        before = now
