"""Approximate nearest neighbours from balanced, overlapping posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotag.llm.common import join_hot, staged

#: Vectors that the centroids are fitted on, at most (expected number).
SAMPLE = 20_000
#: A vector joins every list whose centroid is at most this many times as far
#: as its nearest one (squared distance), up to COPIES lists; a query reads
#: every list within PROBE times the distance of its nearest one, and more of
#: them until they hold ENOUGH postings for each neighbour wanted.
BOUNDARY, COPIES, PROBE = 1.15, 4, 1.25
ENOUGH = 64
#: Postings that a list should have at most: a larger one is split at the medians
#: of a tree of up to 2 ** MOST_DEPTH parts, fitted on SPLIT_SAMPLE of its vectors
#: a part.
LIST_ROWS, MOST_DEPTH, SPLIT_SAMPLE = 2048, 8, 32
#: Postings and queries that one comparison holds; more of either are dealt to
#: several.  Bytes of trees that are broadcast, at most.
BLOCK_ROWS, QUERY_ROWS, BROADCAST_BYTES = 32_768, 8_192, 64 << 20
DEGREE, ENTRIES, BEAM = 24, 16, 32
#: Nearest centroids that are sorted for a row; the others only where these are
#: not enough.
SORTED = 4 * BEAM


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of a balanced clustering: halve the largest cluster at the
    median of its main direction until there are k, then settle them."""
    rng = np.random.default_rng(7)
    parts = [np.arange(len(x))]
    while len(parts) < min(k, len(x)):
        i = max(range(len(parts)), key=lambda j: len(parts[j]))
        own = x[parts[i]] - x[parts[i]].mean(0)
        v = rng.normal(size=x.shape[1])
        for _ in range(6):
            v = own.T @ (own @ v)
            v /= np.linalg.norm(v) or 1
        order = np.argsort(own @ v, kind="stable")
        half = len(order) // 2
        parts[i : i + 1] = [parts[i][order[:half]], parts[i][order[half:]]]
    c = np.stack([x[p].mean(0) for p in parts])
    for _ in range(4):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class CentroidGraph:
    """Centroids linked to their nearest ones, searched best first."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        k = len(centroids)
        sq = (centroids * centroids).sum(1)
        links = np.empty((k, min(DEGREE, k)), np.int64)
        for at in range(0, k, 1024):
            d = sq - 2 * centroids[at : at + 1024] @ centroids.T
            links[at : at + 1024] = np.argsort(d, axis=1, kind="stable")[:, : links.shape[1]]
        # a few far links keep the graph in one piece
        step = np.arange(k)
        far = np.stack([(step + k * i // 5 + 1) % k for i in range(1, 5)], axis=1)
        return cls(centroids, np.concatenate([links, far], axis=1), np.linspace(0, k - 1, min(ENTRIES, k)).astype(np.int64))

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """For each row its squared distances from the centroids that it met (inf
        from the others).

        Rows move through the graph together: each step expands every row's
        nearest unexpanded centroid, until that is neither within ``ratio`` of
        the nearest nor among the BEAM nearest.
        """
        k, n = len(self.centroids), len(x)
        sq, own = (self.centroids**2).sum(1), (x * x).sum(1)
        dist = np.full((n, k), np.inf)
        done = np.zeros((n, k), bool)
        dist[:, self.entries] = np.maximum(own[:, None] + sq[self.entries] - 2 * x @ self.centroids[self.entries].T, 0)
        active = np.arange(n)
        for _ in range(k):
            d = np.where(done[active], np.inf, dist[active])
            at = d.argmin(1)
            best = d[np.arange(len(active)), at]
            met = dist[active]
            beam = np.partition(met, min(BEAM, k) - 1, axis=1)[:, min(BEAM, k) - 1]
            go = np.isfinite(best) & (best <= np.maximum(ratio * met.min(1), beam))
            active, at = active[go], at[go]
            if not len(active):
                break
            done[active, at] = True
            to = self.links[at]
            new = np.maximum(own[active][:, None] + sq[to] - 2 * np.einsum("ij,ikj->ik", x[active], self.centroids[to]), 0)
            dist[active[:, None], to] = new
        return dist

    @staticmethod
    def nearest(dist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest columns of each row, nearest first, and their distances."""
        if most < dist.shape[1]:
            near = np.argpartition(dist, most - 1, axis=1)[:, :most]
            order = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(dist, near, 1)), axis=1), 1)
        else:
            order = np.argsort(dist, axis=1, kind="stable")
        return order, np.take_along_axis(dist, order, 1)

    def within(self, x: np.ndarray, ratio: float, most: int, sizes: np.ndarray | None = None, enough: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per row the lists within ``ratio`` of the nearest, ``most`` at most,
        and further ones until their ``sizes`` add up to ``enough``; with their
        squared distances."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(x), 1024):
            dist = self.search(x[at : at + 1024], ratio)
            order, d = self.nearest(dist, min(SORTED, dist.shape[1]))
            short = d[:, -1] <= ratio * d[:, 0] + 1e-12
            if enough:
                short |= sizes[order].sum(1) < enough
            if SORTED < dist.shape[1] and short.any():  # those that need more are sorted whole
                order, d = self.nearest(dist, dist.shape[1])
            keep = (d <= ratio * d[:, :1] + 1e-12).sum(1)
            if enough:
                keep = np.minimum(np.maximum(keep, (np.cumsum(sizes[order], axis=1) < enough).sum(1) + 1), order.shape[1])
            out += [(o[: min(n, most)], e[: min(n, most)]) for o, e, n in zip(order, d, keep, strict=True)]
        return out


class MedianTree:
    """Halves of halves of a list, each cut at the median of its main direction,
    so all parts have the same share of what it was fitted on."""

    def __init__(self, directions: np.ndarray, cuts: np.ndarray, centroids: np.ndarray):
        self.directions, self.cuts, self.centroids = directions, cuts, centroids

    @classmethod
    def fit(cls, x: np.ndarray, depth: int) -> MedianTree:
        rng = np.random.default_rng(7)
        nodes = [np.arange(len(x))]
        directions, cuts = [], []
        for i in range((1 << depth) - 1):
            own = x[nodes[i]] if len(nodes[i]) else x[:1]
            centred, v = own - own.mean(0), rng.normal(size=x.shape[1])
            for _ in range(6):
                w = centred.T @ (centred @ v)
                v = w / np.linalg.norm(w) if np.linalg.norm(w) > 0 else v / np.linalg.norm(v)
            at = own @ v
            cut = float(np.median(at))
            directions.append(v), cuts.append(cut)
            side = at > cut
            nodes += [nodes[i][~side[: len(nodes[i])]], nodes[i][side[: len(nodes[i])]]]
        leaves = nodes[(1 << depth) - 1 :]
        return cls(np.array(directions), np.array(cuts), np.stack([x[n].mean(0) if len(n) else x.mean(0) for n in leaves]))

    def part(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(len(self.centroids).bit_length() - 1):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.directions[at]) > self.cuts[at])
        return at - len(self.cuts)

    def pack(self) -> bytes:
        return np.concatenate([self.directions.ravel(), self.cuts, self.centroids.ravel()]).tobytes()

    @classmethod
    def unpack(cls, data: bytes, dims: int) -> MedianTree:
        flat = np.frombuffer(data, np.float64)
        leaves = (len(flat) + dims + 1) // (2 * dims + 1)
        n = leaves - 1
        return cls(flat[: n * dims].reshape(n, dims), flat[n * dims : n * (dims + 1)], flat[n * (dims + 1) :].reshape(leaves, dims))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """One more dimension, in which all have the same norm: the largest inner
    product is then the smallest distance."""
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], axis=1)


def _trees(postings: DataFrame, sizes: dict[int, int], most: float) -> DataFrame | None:
    """(list, tree) for the lists that are too large, each fitted by one task on a
    bounded sample of its vectors; None if there are none."""
    depth = {i: min(MOST_DEPTH, int(np.ceil(np.log2(n / LIST_ROWS)))) for i, n in sizes.items() if n > LIST_ROWS}
    if not depth:
        return None
    spark = postings.sparkSession
    shares = [(i, d, min(1_000_000, int(1_000_000 * (SPLIT_SAMPLE << d) / sizes[i]) + 1)) for i, d in depth.items()]
    chosen = postings.join(F.broadcast(spark.createDataFrame(shares, "list int, depth int, share int")), "list")  # a row for each centroid
    chosen = chosen.where(F.pmod(F.xxhash64("gid"), F.lit(1_000_000)) < F.col("share")).select("list", "depth", "gid", "vec")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("gid")
        tree = MedianTree.fit(_lifted(_matrix(t.column("vec")), most), t.column("depth")[0].as_py())
        return pa.table({"list": pa.array([t.column("list")[0].as_py()], pa.int32()), "tree": pa.array([tree.pack()], pa.binary())})

    return staged(chosen.groupBy("list").applyInArrow(fit, "list int, tree binary"), "ann-trees")


def _with_trees(rows: DataFrame, trees: DataFrame | None) -> DataFrame:
    """Rows with their list's tree, or null."""
    if trees is None:
        return rows.withColumn("tree", F.lit(None).cast("binary"))
    size = trees.agg(F.coalesce(F.sum(F.octet_length("tree")), F.lit(0))).first()[0]
    return rows.join(F.broadcast(trees), "list", "left") if size <= BROADCAST_BYTES else join_hot(rows, trees, "list", "left", "ann")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, boundary: float = BOUNDARY, probe: float = PROBE) -> DataFrame:
    """The k rows of largest inner product for every query row.

    ``is_query`` is a condition on ``id_col``.  Equal vectors are one entry of
    the index with its k + 1 smallest ids, which is all that ties to the smaller
    id can need, so copies cost nothing.  Centroids, about the square root of
    the number of entries, are fitted on a bounded sample; every entry is in the
    list of its nearest centroid and of others nearly as near.  A list that gets
    more than LIST_ROWS is split at medians by a tree of its own, so lists stay
    balanced and their number grows with the entries while the graph of
    centroids, which queries and vectors search, stays bounded.  Queries prune
    lists and parts by the ratio of distances.  A comparison holds a bounded
    number of postings and of queries.  Scores are computed in double precision
    on the original vectors.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, and neither do those of another length than most have (ties: the
    longer).  Null ids take no part.  An id that is repeated is excluded as a
    whole from its own neighbours; repeated rows count once.  An empty table
    gives an empty result; other columns, whatever their names, are ignored.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    none = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    v = F.col("vec")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0))
    rows = staged(rows.withColumn("norm", F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))), "ann-rows")
    dims = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return none
    rows = rows.where(F.size("vec") == dims.d)

    # one entry for each different vector; its smallest ids by two rounds of ranking
    salted = Window.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    ranked = Window.partitionBy("vec").orderBy("id")
    ids = rows.select("id", "vec").distinct().withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    ids = ids.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    entries = staged(ids.groupBy("vec").agg(F.min("id").alias("gid"), F.array_sort(F.collect_list("id")).alias("ids")), "ann-entries")
    n, = entries.agg(F.count("*")).first()
    most, = rows.agg(F.max("norm")).first()
    part = min(1.0, sample / n)
    fitted = entries.where(F.pmod(F.xxhash64("gid"), F.lit(1_000_000)) < int(part * 1_000_000)).select("vec").toArrow()
    if not fitted.num_rows:
        fitted = entries.orderBy("gid").limit(1).select("vec").toArrow()
    x = _lifted(_matrix(fitted.column(0)), most)
    graph = CentroidGraph.build(_fit(x, max(1, min(round(n**0.5), max(1, len(x) // 16)))))
    shared = spark.sparkContext.broadcast(graph)  # as many centroids as the sample allows

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [own for own, _ in shared.value.within(_lifted(_matrix(b.column("vec")), most), boundary, COPIES)]
            at = np.repeat(np.arange(len(lists)), [len(o) for o in lists])
            yield pa.RecordBatch.from_arrays([b.column("gid").take(pa.array(at)), b.column("vec").take(pa.array(at)), pa.array(np.concatenate(lists) if lists else [], pa.int32())], names=["gid", "vec", "list"])

    vec_kind = vectors.schema[vec_col].dataType.simpleString()
    postings = staged(entries.select("gid", "vec").mapInArrow(posted, f"gid {kind}, vec {vec_kind}, list int"), "ann-postings")
    sizes = {r.list: r["count"] for r in postings.groupBy("list").count().collect()}  # a row for each centroid
    held = np.array([sizes.get(i, 0) for i in range(len(graph.centroids))])
    trees = _trees(postings, sizes, most)
    dims = x.shape[1]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, part, tree = b.column("list").to_numpy(), np.zeros(len(b), np.int32), b.column("tree")
            y = _lifted(_matrix(b.column("vec")), most)
            for one in np.unique(lists):
                own = np.flatnonzero(lists == one)
                if tree[int(own[0])].is_valid:
                    part[own] = MedianTree.unpack(tree[int(own[0])].as_py(), dims).part(y[own])
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("vec"), b.column("list"), pa.array(part)], names=["gid", "vec", "list", "part"])

    placed = staged(_with_trees(postings, trees).mapInArrow(split, f"gid {kind}, vec {vec_kind}, list int, part int"), "ann-placed")

    asked = staged(rows.where(is_query).select("id", "vec").distinct(), "ann-queries")
    wanted = staged(asked.select("vec").distinct().join(entries.select("vec", "gid"), "vec"), "ann-wanted")
    enough = ENOUGH * (k + 1)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.within(np.pad(_matrix(b.column("vec")), ((0, 0), (0, 1))), probe, 1 << 30, held, enough)
            at = pa.array(np.repeat(np.arange(len(found)), [len(o) for o, _ in found]))
            joined = [np.concatenate(v) if found else np.empty(0) for v in zip(*found, strict=True)] or [np.empty(0), np.empty(0)]
            yield pa.RecordBatch.from_arrays([b.column("gid").take(at), b.column("vec").take(at), pa.array(joined[0], pa.int32()), pa.array(joined[1], pa.float64())], names=["gid", "vec", "list", "d"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A list's parts, each with its own distance from the query."""
        for b in batches:
            at, part, d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            y, lists, tree, far = np.pad(_matrix(b.column("vec")), ((0, 0), (0, 1))), b.column("list").to_numpy(), b.column("tree"), b.column("d").to_numpy()
            for one in np.unique(lists):
                own = np.flatnonzero(lists == one)
                if not tree[int(own[0])].is_valid:
                    at.append(own), part.append(np.zeros(len(own), np.int64)), d.append(far[own])
                    continue
                c = MedianTree.unpack(tree[int(own[0])].as_py(), dims).centroids
                d.append(np.maximum((y[own] ** 2).sum(1)[:, None] + (c**2).sum(1) - 2 * y[own] @ c.T, 0).ravel())
                at.append(np.repeat(own, len(c))), part.append(np.tile(np.arange(len(c)), len(own)))
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([b.column("gid").take(at), b.column("vec").take(at), b.column("list").take(at), pa.array(np.concatenate(part), pa.int32()), pa.array(np.concatenate(d))], names=["gid", "vec", "list", "part", "d"])

    schema = f"gid {kind}, vec {vec_kind}, list int, d double"
    near = _with_trees(wanted.select("gid", "vec").mapInArrow(probed, schema), trees).mapInArrow(parts, schema.replace("list int", "list int, part int"))
    key = ["list", "part"]
    # a few numbers for each part of a list; there are 2 ** MOST_DEPTH parts of each at most
    counts = staged(placed.groupBy(*key).agg(F.count("*").alias("n")), "ann-parts")
    nearest_first = Window.partitionBy("gid").orderBy("d", "list", "part")  # a query's lists and parts
    near = near.join(F.broadcast(counts), key).withColumn("before", F.coalesce(F.sum("n").over(nearest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = near.withColumn("least", F.min("d").over(Window.partitionBy("gid"))).where((F.col("d") <= F.col("least") * probe + 1e-12) | (F.col("before") < enough))
    near = staged(near.select("gid", "vec", *key), "ann-near")
    plan = counts.join(near.groupBy(*key).agg(F.count("*").alias("asked")), key).select(
        *key, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("chunks"), F.ceil(F.col("asked") / QUERY_ROWS).cast("int").alias("salts")
    )
    plan = F.broadcast(staged(plan, "ann-plan"))
    dealt = lambda c: F.pmod(F.xxhash64("gid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = [*key, "chunk", "salt"]
    queries = near.join(plan, key).withColumn("salt", dealt("salts")).withColumn("chunk", every("chunks")).select("gid", "vec", *block)
    listed = placed.join(plan, key).withColumn("chunk", dealt("chunks")).withColumn("salt", every("salts")).select("gid", "vec", *block)

    def compare(q: pa.Table, p: pa.Table) -> pa.Table:
        out = pd.DataFrame({"q": [], "gid": [], "score": []})
        if len(q) and len(p):
            qx, px = _matrix(q.column("vec")), _matrix(p.column("vec"))
            found = []
            for i in range(0, len(qx), 512):
                s = qx[i : i + 512] @ px.T
                if s.shape[1] > k + 1:
                    close = s >= np.partition(s, -(k + 1), axis=1)[:, -(k + 1)][:, None] - 1e-9
                else:
                    close = np.ones_like(s, bool)
                a, b = np.nonzero(close)
                found.append(np.stack([a + i, b]))
            a, b = np.concatenate(found, axis=1)
            out = pd.DataFrame({"q": a, "gid": p.column("gid").to_numpy()[b], "score": np.einsum("ij,ij->i", qx[a], px[b])})
            out = out.sort_values(["q", "score", "gid"], ascending=[True, False, True])
            out = out[out.groupby("q").cumcount() <= k]
            out["q"] = q.column("gid").to_numpy()[out["q"]]
        types = p.schema.field("gid").type
        return pa.table({"q": pa.array(out["q"], types), "gid": pa.array(out["gid"], types), "score": pa.array(out["score"], pa.float64())})

    met = queries.groupBy(*block).cogroup(listed.groupBy(*block)).applyInArrow(compare, f"q {kind}, gid {kind}, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "gid")
    top = met.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    named = top.join(entries.select("gid", "ids"), "gid").select("q", "score", F.explode("ids").alias("vec_id"))
    own = asked.join(wanted.select("vec", F.col("gid").alias("q")), "vec").select("q", F.col("id").alias("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = own.join(named, "q").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
