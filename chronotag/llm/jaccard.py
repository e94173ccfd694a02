"""Jaccard self-join of documents on word shingles, with adaptive prefixes."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.llm.common import HOT_SHARES, discard, fresh, join_hot, staged
from chronotag.llm.graphs import components

#: Counters of the frequency sketch, and of one row of it.
SKETCH, SKETCH_ROW = 1 << 22, 1 << 16
#: Shared prefix tokens that a document may ask for, and the cost of verifying
#: a candidate against that of reading a posting.
MOST_MATCHES, VERIFY_COST = 8, 16
#: Rounds of contraction before all pairs that are left are verified.
ROUNDS = 3
#: Document ids are broadcast up to this number (16 MB of longs).
BROADCAST_IDS = 1_000_000
CACHED_WORDS = 500_000
#: Bits of a set's parity map, in words of 64.
MAP_WORDS = 8
#: Candidates that a token's group writes as pairs, for each of its rows; a denser
#: group's classes are compared with their sets at hand, in blocks of so many tokens.
PAIRS_A_ROW, BLOCK_TOKENS = 4, 1 << 19
_SPACE = re.compile(rb"[ \t-\r]")
_SEGMENT = 1 << 22


class _Words(dict):
    """Word -> 64-bit hash, remembered while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def _word_hashes(text: str) -> np.ndarray:
    data, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        cut = _SPACE.search(data, at + _SEGMENT) if len(data) - at > _SEGMENT else None
        end = cut.start() if cut else len(data)
        words = data[at:end].lower().split()  # bytes: A-Z only; space and 09-0D only
        parts.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    w = _word_hashes(text or "")
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _class_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _parity_map(tokens: np.ndarray) -> bytes:
    """A bit for each hash value of 64 * MAP_WORDS: whether an odd number of the
    set's tokens has it.  Maps of two sets differ in no more bits than the sets
    in tokens."""
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % (64 * MAP_WORDS), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


@dataclass(frozen=True)
class Rule:
    """k-word shingles; sets link when den * intersection >= num * union."""

    k: int = 4
    num: int = 85
    den: int = 100

    def most_apart(self, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
        """In how many tokens linked sets of n and m may differ."""
        return n + m - 2 * -(-(n + m) * self.num // (self.num + self.den))

    def least_overlap(self, n: int) -> int:
        """What a set of n shares at least with any set that it links with."""
        return -(-self.num * n // self.den)


def _profile(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document (doc_id, c, n, map), and rows of sketch counts (row, counts)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, c long, n int, map binary, row int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, any_ = np.zeros(SKETCH, np.uint32), False
        for batch in batches:
            cs, ns, maps = [], [], []
            for i in range(0, len(batch), 512):
                sets = [shingle_set(t, rule.k) for t in batch.column(1).slice(i, 512).to_pylist()]
                cs += map(_class_of, sets)
                ns += map(len, sets)
                maps += map(_parity_map, sets)
                if any(ns[-len(sets) :]):
                    any_ = True
                    np.add(sketch, np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32), out=sketch)
            none = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cs, pa.int64()), pa.array(ns, pa.int32()), pa.array(maps, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=["doc_id", "c", "n", "map", "row", "counts"])
        if any_:
            rows = SKETCH // SKETCH_ROW
            data = [r.tobytes() for r in sketch.reshape(rows, -1)]
            ids = pa.nulls(rows, docs_type)
            yield pa.RecordBatch.from_arrays([ids, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), pa.array(range(rows), pa.int32()), pa.array(data, pa.binary())], names=["doc_id", "c", "n", "map", "row", "counts"])

    from pyspark.sql.pandas.types import to_arrow_type

    docs_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.mapInArrow(run, schema)


def _sketch(profile: DataFrame) -> np.ndarray:
    """The summed sketch: SKETCH counters, whatever the size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, np.uint32)
                total[row] = total[row] + own if row in total else own.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in total.values()], pa.binary())], names=["row", "counts"])

    rows = profile.where(F.col("row").isNotNull()).select("row", "counts").repartition(16, "row").mapInArrow(add, "row int, counts binary")
    out = np.zeros((SKETCH // SKETCH_ROW, SKETCH_ROW), np.uint32)
    for r in rows.toLocalIterator():
        out[r.row] = np.frombuffer(bytes(r.counts), np.uint32)
    return out.reshape(-1)


def _prefix(tokens: np.ndarray, counts: np.ndarray, noise: float, rule: Rule) -> tuple[np.ndarray, int, int]:
    """The rarest tokens of a set that a link must share ``m`` of, m, and how
    often these tokens occur elsewhere on average: most for what copies were
    made from, whose rarest tokens its copies have too.

    A prefix one token longer asks for one more match.  That reads more
    postings and leaves fewer candidates to verify; the cheapest m is taken,
    by the sketch's estimate of how often each token occurs elsewhere.
    """
    n = len(tokens)
    overlap = rule.least_overlap(n)
    f = counts[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
    longest = n - overlap + min(MOST_MATCHES, overlap)
    order = np.lexsort((tokens, f))[:longest]
    others = np.cumsum(np.maximum(f[order] - 1 - noise, 0))
    m = np.arange(1, longest - (n - overlap) + 1)
    reads = others[n - overlap :] + m
    best = int(np.argmin(reads + VERIFY_COST * others[n - overlap :] / m)) + 1
    size = n - overlap + best
    return tokens[order[:size]], best, min(int(f[order[:size]].mean()), 2**31 - 1)


def _postings(docs: DataFrame, sketch: np.ndarray, rule: Rule) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        noise = 3 * float(counts.mean()) if counts.size else 0.0
        for batch in batches:
            for i in range(0, len(batch), 256):
                seen, out, cs, ns, ms, ws = set(), [], [], [], [], []
                for text in batch.column(1).slice(i, 256).to_pylist():
                    tokens = shingle_set(text, rule.k)
                    if not len(tokens) or (c := _class_of(tokens)) in seen:
                        continue
                    seen.add(c)
                    prefix, m, w = _prefix(tokens, counts, noise, rule)
                    out.append(prefix.view(np.int64)), cs.append(c), ns.append(len(tokens)), ms.append(m), ws.append(w)
                if out:
                    sizes = [len(x) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), *(pa.array(np.repeat(np.array(v, t), sizes)) for v, t in ((cs, np.int64), (ns, np.int32), (ms, np.int32), (ws, np.int32)))], names=["token", "c", "n", "m", "w"])

    return docs.mapInArrow(run, "token long, c long, n int, m int, w int")


def _runs(batches: Iterator[pa.RecordBatch], key: str = "token") -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, cut so that no run of equal keys is split."""
    kept: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not len(batch):
            continue
        cols = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        if kept is not None:
            cols = {k: np.concatenate([kept[k], v]) for k, v in cols.items()}
        token = cols[key]
        cut = int(np.searchsorted(token, token[-1], "left"))
        if cut:
            yield {k: v[:cut] for k, v in cols.items()}
        kept = {k: v[cut:] for k, v in cols.items()}
    if kept is not None:
        yield kept


def _shared_only(postings: DataFrame) -> DataFrame:
    """Postings whose token another class has too, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(batches):
            token, c = x["token"], x["c"]
            again = np.concatenate([[False], (token[1:] == token[:-1]) & (c[1:] == c[:-1])])
            x = {k: v[~again] for k, v in x.items()}  # a class met in several tasks
            new = np.concatenate([[True], x["token"][1:] != x["token"][:-1]])
            keep = ~(new & np.concatenate([new[1:], [True]]))
            yield pa.RecordBatch.from_arrays([pa.array(x[k][keep]) for k in x], names=list(x))

    dealt = postings.repartition("token").sortWithinPartitions("token", "c")
    return dealt.mapInArrow(run, "token long, c long, n int, m int, w int")


#: Blocks that the postings of a hot token are dealt to, at most.
MOST_BLOCKS = 32


def _blocked(postings: DataFrame) -> DataFrame:
    """Postings with ``block`` and ``blocks``: a token that holds more than
    1/HOT_SHARES of all postings has several blocks, by a hash of the class."""
    counts = staged(postings.groupBy("token").agg(F.count("*").alias("n")), "jaccard-tokens")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") * HOT_SHARES > total).select("token", F.least(F.ceil(F.col("n") * HOT_SHARES / F.lit(max(1, total))), F.lit(MOST_BLOCKS)).cast("int").alias("blocks"))
    rows = postings.join(F.broadcast(hot), "token", "left")  # HOT_SHARES tokens at most
    return rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))


def _group(*columns: str) -> Column:
    """A token, or a hash of a hot one and its block or blocks."""
    return F.when(F.col("blocks") == 1, F.col("token")).otherwise(F.xxhash64("token", *columns))


def _promising(postings: DataFrame, rule: Rule) -> DataFrame:
    """For each class the pair (a, b) of it and one of another component that
    shares most tokens with it, of those that it meets first.

    A token's classes are sorted by how common their rarest tokens are, so the
    first is most likely what the others were copied from; a class meets that
    one and the last one before it of another component.  The blocks of a hot
    token are tokens of their own here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(batches, "g"):
            token, comp, n, c = (x[k] for k in ("g", "comp", "n", "c"))
            n = n.astype(np.int64)
            at = np.arange(len(token))
            new = np.concatenate([[True], token[1:] != token[:-1]])
            start = np.maximum.accumulate(np.where(new, at, 0))
            stretch = np.maximum.accumulate(np.where(new | np.concatenate([[True], comp[1:] != comp[:-1]]), at, 0))
            i = np.concatenate([at, at])
            j = np.concatenate([start, np.maximum(stretch - 1, start)])
            ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * rule.den >= np.maximum(n[i], n[j]) * rule.num)
            i, j = i[ok], j[ok]
            yield pa.RecordBatch.from_arrays([pa.array(c[i]), pa.array(np.minimum(c[i], c[j])), pa.array(np.maximum(c[i], c[j]))], names=["c", "a", "b"])

    dealt = postings.select(_group("block").alias("g"), "c", "n", "w", "comp").repartition("g").sortWithinPartitions("g", F.desc("w"), "n", "c")
    met = dealt.mapInArrow(run, "c long, a long, b long").groupBy("c", "a", "b").agg(F.count("*").alias("s"))
    return met.groupBy("c").agg(F.max(F.struct("s", "a", "b")).alias("x")).select("x.a", "x.b").distinct()


class _Forest:
    """Rows of a group, with a label for each part that is connected."""

    def __init__(self, labels: np.ndarray) -> None:
        self.labels = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, j: np.ndarray) -> np.ndarray:
        """Connect row i with the rows j; of these, one of each part that was
        not connected with i."""
        parts, first = np.unique(self.labels[j], return_index=True)
        new = parts != self.labels[i]
        if new.any():
            self.labels[np.isin(self.labels, parts[new])] = self.labels[i]
        return j[first[new]]


def _crossing(postings: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of classes that share a token, could link by size and parity
    map, and are not known to be connected: (a, b, m).

    A group with more of them than PAIRS_A_ROW for each posting would write as
    many as the square of its size.  It writes pairs of components without m
    instead, fewer than rows, that connect the components of every such pair:
    both lie in one family, within which `_within` compares all classes.  A
    pair's count of shared tokens matters only if none of them is such a group's.

    postings is (token, c, n, m, comp, map, block, blocks).  Every two blocks of a
    hot token meet in a group of their own, and so does each block with itself,
    so no task gets all of its postings and no pair of them is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(batches, "g"):
            token, comp, n, c, m, block, blocks, two = (x[k] for k in ("g", "comp", "n", "c", "m", "block", "blocks", "two"))
            n = n.astype(np.int64)
            maps = np.frombuffer(b"".join(x["map"]), np.uint64).reshape(len(token), MAP_WORDS)
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            out, waiting = [], 0
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                    continue
                mine, found, family = [], 0, None
                for i in range(lo, hi - 1):  # rows are sorted by n, so partners are a stretch
                    to = i + 1 + int(np.searchsorted(n[i + 1 : hi] * rule.num, n[i] * rule.den, "right"))
                    apart = comp[i + 1 : to] != comp[i]
                    if two[i]:
                        apart &= block[i + 1 : to] != block[i]
                    j = np.flatnonzero(apart) + i + 1
                    apart = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
                    j = j[apart <= rule.most_apart(n[j], int(n[i]))]
                    if family:
                        j = family.join(i - lo, j - lo) + lo
                    if len(j):
                        mine.append((i, j))
                        found += len(j)
                    if not family and found * blocks[i] > PAIRS_A_ROW * (hi - lo):
                        family = _Forest(comp[lo:hi])
                        mine = [(i, family.join(i - lo, j - lo) + lo) for i, j in mine]
                out += [(np.full(len(j), i), j, np.full(len(j), bool(family))) for i, j in mine]
                waiting += sum(len(j) for _, j in mine)
                if waiting > 100_000:
                    yield _pairs(out, c, m, comp)
                    out, waiting = [], 0
            if out:
                yield _pairs(out, c, m, comp)

    def _pairs(out, c, m, comp) -> pa.RecordBatch:
        i, j, dense = (np.concatenate(v) for v in zip(*out, strict=True))
        x, y = (np.where(dense, comp[k], c[k]) for k in (i, j))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.minimum(m[i], m[j]), mask=dense)], names=["a", "b", "m"])

    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = postings.withColumn("other", F.explode(others)).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    met = met.select(_group("lo", "hi").alias("g"), "c", "n", "m", "comp", "map", "block", "blocks", (F.col("lo") != F.col("hi")).alias("two"))
    dealt = met.repartition("g").sortWithinPartitions("g", "n", "c")
    return dealt.mapInArrow(run, "a long, b long, m int")


def _verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets link; sets is (c, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(rule.den * both >= rule.num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("c").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("c").alias("b"), F.col("tokens").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _within(sets: DataFrame, families: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that connect what links connect within each family; sets is
    (c, tokens), families (c, comp, family), comp the component so far.

    Every class is held against all others of its family that size and parity
    map do not rule out, and that are not connected with it yet.  A group writes
    only links that connect something, so fewer than it has rows.  A family of
    many tokens has blocks, every two of which meet in a group of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(batches, "g"):
            edges = np.flatnonzero(np.concatenate([[True], x["g"][1:] != x["g"][:-1], [True]]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                out = list(_compare(*(x[k][lo:hi] for k in ("comp", "tokens", "block", "two"))))
                if out:
                    i, j = (np.concatenate(v) + lo for v in zip(*out, strict=True))
                    c = x["c"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c[i], c[j])), pa.array(np.maximum(c[i], c[j]))], names=["a", "b"])

    def _compare(comp, tokens, block, two) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = [np.frombuffer(t, np.uint64) for t in tokens]
        maps = np.frombuffer(b"".join(map(_parity_map, own)), np.uint64).reshape(len(own), MAP_WORDS)
        n = np.array([len(t) for t in own], np.int64)
        start = np.cumsum(n) - n
        ids = np.unique(np.concatenate(own), return_inverse=True)[1]
        has = np.zeros(ids.max() + 1, np.int64)
        forest = _Forest(comp)
        for i in range(len(n) - 1):  # sorted by n
            to = i + 1 + int(np.searchsorted(n[i + 1 :] * rule.num, n[i] * rule.den, "right"))
            apart = forest.labels[i + 1 : to] != forest.labels[i]
            if two[i]:
                apart &= block[i + 1 : to] != block[i]
            j = np.flatnonzero(apart) + i + 1
            j = j[np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64) <= rule.most_apart(n[j], int(n[i]))]
            if not len(j):
                continue
            mine = ids[start[i] : start[i] + n[i]]
            has[mine] = 1
            first = np.cumsum(n[j]) - n[j]
            both = np.add.reduceat(has[ids[np.repeat(start[j] - first, n[j]) + np.arange(n[j].sum())]], first)
            has[mine] = 0
            j = forest.join(i, j[rule.den * both >= rule.num * (n[i] + n[j] - both)])
            if len(j):
                yield np.full(len(j), i), j

    rows = staged(sets.join(families, "c").withColumn("n", (F.length("tokens") / 8).cast("long")), "jaccard-dealt")
    large = rows.groupBy("family").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK_TOKENS)  # as many as fill a block
    large = large.select("family", F.ceil(F.col("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    met = rows.join(F.broadcast(large), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    met = met.select(F.when(F.col("blocks") == 1, F.col("family")).otherwise(F.xxhash64("family", "lo", "hi")).alias("g"), "c", "n", "comp", "block", (F.col("lo") != F.col("hi")).alias("two"), "tokens")
    out = staged(met.repartition("g").sortWithinPartitions("g", "n", "c").mapInArrow(run, "a long, b long"), "jaccard-links")
    discard(rows)
    return out


def _sets(docs: DataFrame, members: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(c, tokens) of the wanted classes, from one document of each."""
    one = staged(members.join(wanted.distinct(), "c").groupBy("c").agg(F.min("doc_id").alias("doc_id")), "jaccard-wanted")
    ids = one.select("doc_id").distinct()
    ids = F.broadcast(ids) if one.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                sets = [shingle_set(t, rule.k) for t in batch.column(1).slice(i, 256).to_pylist()]
                part = batch.column(0).slice(i, 256)
                yield pa.RecordBatch.from_arrays([part, pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "c", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.join(ids, "doc_id", "left_semi").mapInArrow(run, f"doc_id {kind}, c long, tokens binary")
    if members.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        # an id may stand for several texts; only the wanted one's set counts, once
        made = made.join(one, ["doc_id", "c"], "left_semi").dropDuplicates(["c"])
    return made.select("c", "tokens")


def _alike(pairs: DataFrame, maps: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that the parity maps do not rule out; maps is (c, n, map)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(batch), MAP_WORDS) for k in ("x", "y"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in ("n", "m"))
            yield batch.select(["a", "b"]).filter(pa.array(apart <= rule.most_apart(n, m)))

    x = maps.select(F.col("c").alias("a"), F.col("map").alias("x"), "n")
    y = maps.select(F.col("c").alias("b"), F.col("map").alias("y"), F.col("n").alias("m"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked by shingle similarity: (doc_id, n_shingles, component_id).

    Words are split at space and 09-0D, A-Z lower-cased; a text of fewer than k
    words is one shingle; one without words, or null, has none and is linked
    with nothing.  component_id is the smallest doc_id that links reach (the own
    one without links); null ids are passed over, and a set that only rows
    without an id have is linked with its equals alone.

    1. Equal sets are one class.  A sketch of fixed size counts shingles.
    2. Every class posts its rarest tokens: as many as any link must share one
       of, or more with correspondingly more matches asked for where the sketch
       promises fewer candidates.
    3. In a few rounds each class is held against one other that shares most
       tokens with it, first of all what it was probably copied from; verified
       links are contracted, so a large group of near copies costs a few
       comparisons a member.
    4. Pairs that still lie in different components, share enough prefix tokens
       for either side's prefix, and are not ruled out by size or by a small map
       of both sets, are all verified: one by one, or, where a token's classes
       have many of them, within the family of such classes, each of whose sets
       is read once for a block of it and whose links are contracted at once.

    Nothing is capped: step 4 alone would find every connection, step 3 only
    spares it pairs whose documents are known to be connected.  Repeated rows
    get equal results; an empty table gives an empty result; other columns,
    whatever their names, are ignored.  A very long text is hashed in segments
    and its whole set is held by one task.  Sets are compared by 64-bit hashes.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    profile = staged(_profile(own, rule), "jaccard-profile")
    members = profile.where(F.col("row").isNull()).select("doc_id", "c", "n")
    shared = staged(_shared_only(_postings(own, _sketch(profile), rule)), "jaccard-shared")
    postings = staged(_blocked(shared), "jaccard-postings")
    discard(shared)

    maps = staged(profile.where(F.col("row").isNull()).groupBy("c").agg(F.first("n").alias("n"), F.first("map").alias("map")), "jaccard-maps")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("c")).union(pairs.select("b"))
        sets = staged(_sets(own, members, ends, rule), "jaccard-sets")
        out = staged(_verify(pairs, sets, rule), "jaccard-links")
        discard(sets)
        return out

    tried = links = known = None
    posted = postings.withColumn("comp", F.col("c"))
    for _ in range(ROUNDS):
        pairs = _promising(posted, rule)
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "jaccard-promising")
        found = verified(staged(_alike(pairs, maps, rule), "jaccard-alike"))
        tried = tried.union(pairs) if tried else pairs
        if links and not found.limit(1).count():
            break
        links = links.union(found) if links else found
        known = components(links, "jaccard-known")
        posted = postings.join(known, F.col("c") == F.col("node"), "left").select("token", "c", "n", "m", "w", "block", "blocks", F.coalesce("component", "c").alias("comp"))

    met = staged(_crossing(posted.join(maps.select("c", "map"), "c"), rule), "jaccard-met")
    pairs = met.where("m IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("s"), F.first("m").alias("m")).where(F.col("s") >= F.col("m")).select("a", "b")
    pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = verified(pairs)
    dense = met.where("m IS NULL").select("a", "b")
    if dense.limit(1).count():
        families = components(dense, "jaccard-dense").select(F.col("node").alias("comp"), F.col("component").alias("family"))
        families = staged(join_hot(posted.select("c", "comp").distinct(), families, "comp", "inner", "jaccard-dense"), "jaccard-families")
        sets = staged(_sets(own, members, families.select("c"), rule), "jaccard-sets")
        more = more.union(_within(sets, families, rule))
        discard(families, sets)
    discard(postings, met, pairs, maps)
    # every found link, and every class as it was contracted
    joined = components(more.union(known.select(F.col("node").alias("a"), F.col("component").alias("b"))), "jaccard-components")

    # each class's smallest id, then each component's: both are aggregates with partial sums
    classes = staged(members.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first")), "jaccard-classes")
    named = staged(classes.join(joined, F.col("c") == F.col("node"), "left").select("c", "first", F.coalesce("component", "c").alias("comp")), "jaccard-named")
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_class = staged(join_hot(named.select("c", "comp"), least, "comp", "inner", "jaccard-components").select("c", "component_id"), "jaccard-by-class")
    every = members.withColumn("c", F.when(F.col("n") > 0, F.col("c")))
    return join_hot(every, by_class, "c", "left", "jaccard-classes").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, rule: Rule = Rule(5, 80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but for documents that links connect
    with a smaller id; of rows with one id one stays.

    Texts without words, null or empty, and rows without an id are linked with
    nothing and stay; columns may have any names; an empty table gives an empty
    one.
    """
    out = fresh("_gone", docs)
    found = staged(jaccard_components(docs, rule, id_col, text_col), "jaccard-found")
    gone = staged(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(out)).distinct(), "jaccard-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, docs[id_col] == F.col(out), "left_anti")
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.where(F.col(id_col).isNull()).unionByName(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])) if twice else kept


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: The query's SQL: all pairs that share a shingle, and what links reach.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS sh FROM d WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(r, o) AS (SELECT r, r FROM d UNION SELECT reached.r, ends.b FROM reached JOIN ends ON reached.o = ends.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(x.doc_id) AS component_id
FROM d JOIN reached USING (r) JOIN d x ON x.r = reached.o LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
