"""Removal of repeated byte strings by suffix order within anchored shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.llm.common import staged
from chronotag.llm.induced import MEMORY, ROWS, Queue, Scratch, sorted_blocks, suffix_order

LENGTH = 50
#: Bytes that an anchor's hash covers.
GRAM = 16
#: Segment bytes that a shard is meant to hold, and the largest number of shards;
#: beyond it shards grow, far above MEMORY, which is what a shard's sorts hold.
SHARD_BYTES, MOST_SHARDS = 8 << 20, 4096
#: Text that is cut at a time, and segment bytes gathered before they are packed.
TEXT_BYTES, FLUSH = 1 << 20, 1 << 17
#: Documents whose spans are broadcast, at most, and bytes of their spans.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def _window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """For every start of a ``length``-byte window the least hash of the GRAM-byte
    strings in it: equal windows have equal keys."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(), shape=(len(data), 8), strides=(1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    h = (words[: len(data) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[GRAM - 8 : len(data) - 8 + 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    span, step = length - GRAM + 1, 1
    while 2 * step <= span:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (span - step)], h[span - step :]) if span > step else h


class _Blobs:
    """Segments gathered per shard, compressed when there are enough."""

    def __init__(self, shards: int):
        self.shards = shards
        self.parts: dict[int, list[tuple]] = {}
        self.size: dict[int, int] = {}
        self.pack = zstandard.ZstdCompressor(level=3).compress

    def add(self, key, doc, start, length, data) -> Iterator[tuple[int, bytes]]:
        shard = (key >> np.uint64(32)) % np.uint64(self.shards)
        key = key.astype(np.uint32) >> np.uint32(8)  # keys that fall together only make a larger group
        order = np.argsort(shard, kind="stable")
        key, doc, start, length, shard = key[order], doc[order], start[order], length[order], shard[order]
        first = np.cumsum(length) - length
        content = data[np.repeat(start - first, length) + np.arange(int(length.sum()))]
        start = start - doc[:, 2]  # in its document from here on
        doc = doc[:, :2]
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        ends = np.concatenate([first, [len(content)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s = int(shard[lo])
            self.parts.setdefault(s, []).append((key[lo:hi], doc[lo:hi], start[lo:hi], length[lo:hi].astype(np.int32), content[ends[lo] : ends[hi]]))
            self.size[s] = self.size.get(s, 0) + int(ends[hi] - ends[lo])
            if self.size[s] >= FLUSH:
                yield s, self.flush(s)

    def flush(self, s: int) -> bytes:
        parts = self.parts.pop(s)
        del self.size[s]
        return _packed([np.concatenate([p[i] for p in parts]) for i in range(5)], self.pack)


def _planes(column: np.ndarray) -> bytes:
    """First all numbers' first bytes, then all second ones: they compress well."""
    return np.ascontiguousarray(column.reshape(-1, 1).view(np.uint8).reshape(-1, column.itemsize).T).tobytes()


def _packed(columns: list[np.ndarray], pack) -> bytes:
    key, doc, start, length, content = columns
    numbers = (key.astype(np.uint32), doc[:, 0], doc[:, 1], start.astype(np.int64), length.astype(np.int32))
    return len(key).to_bytes(8, "little") + pack(b"".join(_planes(np.ascontiguousarray(c)) for c in numbers) + np.ascontiguousarray(content).tobytes())


def _unpacked(blob: bytes) -> list[np.ndarray]:
    """key, doc (id and text hash), start, length, content."""
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    out, at = [], 0
    for kind in (np.uint32, np.int64, np.int64, np.int64, np.int32):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [out[0], np.stack(out[1:3], axis=1), out[3], out[4], raw[at:]]


def _segments(docs: DataFrame, shards: int, length: int) -> DataFrame:
    """Blobs per shard of the stretches of text whose windows share a key.

    docs is (doc_id long, text_hash long, text)."""

    def cut(ids: list, hashes: list, texts: list[bytes], blobs: _Blobs) -> Iterator[tuple[int, bytes]]:
        sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) < length:
            return
        key = _window_keys(data, length)
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(texts)), sizes)[: len(key)]
        whole = np.arange(len(key)) + length <= ends[of]  # windows within one text
        at = np.flatnonzero(whole)
        if not len(at):
            return
        new = np.concatenate([[True], (key[at[1:]] != key[at[:-1]]) | (at[1:] != at[:-1] + 1)])
        first = at[new]
        last = at[np.concatenate([new[1:], [True]])]
        doc = np.stack([np.array(ids, np.int64), np.array(hashes, np.int64), ends - sizes], axis=1)[of[first]]
        for s, blob in blobs.add(key[first], doc, first, last - first + length, data):
            yield s, blob

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = _Blobs(shards)

        def made(pairs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], names=["shard", "blob"])

        rows: list = [[], [], []]
        size = 0
        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                if i is None or len(text) < length:
                    continue
                rows[0].append(i), rows[1].append(h), rows[2].append(text)
                size += len(text)
                if size >= TEXT_BYTES:
                    for pair in cut(*rows, blobs):
                        yield made([pair])
                    rows, size = [[], [], []], 0
        for pair in cut(*rows, blobs) if size else ():
            yield made([pair])
        for s in list(blobs.parts):
            yield made([(s, blobs.flush(s))])

    return docs.mapInArrow(run, "shard int, blob binary")


class Shard:
    """A shard's segments on disk, and the bytes of them that smaller documents
    hold, with at most about ``memory`` bytes of rows in memory."""

    def __init__(self, length: int, memory: int):
        self.length, self.scratch, self.count = length, Scratch(memory), 0
        self.table = Queue(self.scratch, np.uint32, np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.data = Queue(self.scratch, np.uint8)

    def add(self, part: list[np.ndarray]) -> None:
        """Segments as :func:`_unpacked` gives them."""
        key, doc, start, size, data = part
        size, view = size.astype(np.int64), memoryview(data)
        ends = np.cumsum(size)
        names = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True))
        names = np.frombuffer(names, np.uint64).reshape(-1, 2)
        self.table.put(key, doc[:, 0], doc[:, 1], start, size, names[:, 0], names[:, 1])
        self.data.put(data)
        self.count += len(key)

    def _columns(self) -> list[np.ndarray]:
        out = [self.scratch.array(self.count, k) for k in self.table.kinds]
        at = 0
        for block in self.table.blocks():
            for column, values in zip(out, block, strict=True):
                column[at : at + len(values)] = values
            at += len(block[0])
        return out

    def _groups(self, *keys: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """For each kept segment the number of its group, by one or two keys."""
        m = self.count
        of = self.scratch.array(m, np.int64)

        def rows() -> Iterator[list[np.ndarray]]:
            for i in range(0, m, ROWS):
                j = np.arange(i, min(i + ROWS, m))
                j = j if keep is None else j[keep[i : i + ROWS]]
                yield [*(k[j] for k in keys), j]

        at, last, head = 0, None, 0
        for *k, j in sorted_blocks(self.scratch, rows(), len(keys)):
            if not len(j):
                continue
            new = np.concatenate([[last is None or any(c[0] != x for c, x in zip(k, last, strict=True))], np.logical_or.reduce([c[1:] != c[:-1] for c in k])])
            heads = np.maximum.accumulate(np.where(new, np.arange(at, at + len(j)), head))
            of[j] = heads
            at, last, head = at + len(j), [c[-1] for c in k], int(heads[-1])
        return of

    def _several(self, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a segment's key is one that several documents have."""
        m, of = self.count, self._groups(key)
        least, several = self._least(of, doc, None), self.scratch.array(m, bool)
        for i in range(0, m, ROWS):
            own = of[i : i + ROWS]
            several[own[doc[i : i + ROWS] != least[own]]] = True
        out = self.scratch.array(m, bool)
        for i in range(0, m, ROWS):
            out[i : i + ROWS] = several[of[i : i + ROWS]]
        return out

    def _least(self, of: np.ndarray, values: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
        """The least value of each group."""
        out = self.scratch.array(self.count, np.int64)
        for i in range(0, self.count, ROWS):
            out[i : i + ROWS] = np.iinfo(np.int64).max
        for i in range(0, self.count, ROWS):
            j = np.arange(i, min(i + ROWS, self.count))
            j = j if keep is None else j[keep[i : i + ROWS]]
            np.minimum.at(out, of[j], values[j])
        return out

    def _text(self, first: np.ndarray, size: np.ndarray, to: np.ndarray, total: int) -> np.ndarray:
        """The kept segments behind one another, a zero after each; ``to`` is
        where a segment goes, or less than 0."""
        out, at = self.scratch.array(total + self.length + 8, np.uint8), 0
        for (block,) in self.data.blocks():
            lo, hi = int(np.searchsorted(first, at, "right")) - 1, int(np.searchsorted(first, at + len(block), "left"))
            i = np.arange(lo, hi)[to[lo:hi] >= 0]
            a, b = np.maximum(first[i], at), np.minimum(first[i] + size[i], at + len(block))
            n = np.maximum(b - a, 0)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[i] + a - first[i], n) + step] = block[np.repeat(a - at, n) + step]
            at += len(block)
        return out

    def repeats(self) -> Iterator[np.ndarray]:
        """Rows (doc_id, text_hash, from, to) of bytes to remove; parts of one
        stretch may come as several rows that touch or overlap.

        Equal stretches are aggregated before they are sorted: the smallest
        document's stands for all, and those of larger ones are removed.
        """
        key, doc, hash_, start, size, a, b = self._columns()
        m, keep = self.count, self._several(key, doc)
        of = self._groups(a, b, keep=keep)
        least = self._least(of, doc, keep)
        first, at = self.scratch.array(m, np.int64), 0
        owned = self.scratch.array(m, bool)  # segments of their content's smallest document
        for i in range(0, m, ROWS):
            j = np.arange(i, min(i + ROWS, m))
            first[i : i + ROWS] = at + np.cumsum(size[j]) - size[j]
            at += int(size[j].sum())
            j = j[keep[j]]
            later = doc[j] > least[of[j]]
            owned[j[~later]] = True
            j = j[later]
            if len(j):
                yield np.column_stack([doc[j], hash_[j], start[j], start[j] + size[j]])
        sole = self._least(of, np.arange(m), owned)  # the one segment of a content that is sorted
        to, total = self.scratch.array(m, np.int64), 0
        sorted_, others = Queue(self.scratch, np.int64), Queue(self.scratch, np.int64, np.int64)
        for i in range(0, m, ROWS):
            j = np.arange(i, min(i + ROWS, m))
            one = owned[j] & (sole[of[j]] == j)
            room = np.where(one, size[j] + 1, 0)
            to[j] = np.where(one, total + np.cumsum(room) - room, -1)
            total += int(room.sum())
            sorted_.put(j[one])
            more = j[owned[j] & ~one]  # the same document has it again
            others.put(sole[of[more]], more)
        if not total:
            return
        padded = self._text(first, size, to, total)
        # each position's segment
        holder = self.scratch.array(total, np.int32 if m < 1 << 31 else np.int64)
        for (j,) in sorted_.blocks():
            lo, hi = int(to[j[0]]), int(to[j[-1]] + size[j[-1]] + 1)
            holder[lo:hi] = np.repeat(j, size[j] + 1)
        hit = self._hits(padded, total, holder, to, size, doc)
        again = [self.scratch.array(others.size, np.int64) for _ in range(2)]
        at = 0
        for block in sorted_blocks(self.scratch, others.blocks(), 2):
            for column, values in zip(again, block, strict=True):
                column[at : at + len(values)] = values
            at += len(block[0])
        for lo in range(0, total, ROWS):
            windows = lo + np.flatnonzero(hit[lo : lo + ROWS])
            if not len(windows):
                continue
            own = holder[windows]
            new = np.concatenate([[True], (windows[1:] > windows[:-1] + self.length) | (own[1:] != own[:-1])])
            last = np.concatenate([new[1:], [True]])
            j, x, y = own[new], windows[new] - to[own[new]], windows[last] + self.length - to[own[new]]
            yield np.column_stack([doc[j], hash_[j], start[j] + x, start[j] + y])
            n_lo, n_hi = np.searchsorted(again[0], j, "left"), np.searchsorted(again[0], j, "right")
            n = n_hi - n_lo
            if n.any():
                i = again[1][np.repeat(n_lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                yield np.column_stack([doc[i], hash_[i], start[i] + np.repeat(x, n), start[i] + np.repeat(y, n)])

    def _hits(self, padded, total, holder, to, size, doc) -> np.ndarray:
        """Where a window begins that a smaller document's text has: suffixes in
        order that share a window's length with the one before are one run."""
        hit, none = self.scratch.array(total, bool), np.iinfo(np.int64).max
        open_, least = Queue(self.scratch, np.int64, np.int64), none  # the run that may go on

        def close() -> None:
            for at, own in open_.blocks():
                hit[at[own > least]] = True

        for at, lcp in suffix_order(padded, total, self.length, self.scratch):
            new = lcp < self.length
            shared = ~(new & np.append(new[1:], False))  # not a run of its own, as far as is known
            at, new = at[shared].astype(np.int64), new[shared]
            if not len(at):
                continue
            j = holder[at]
            whole = at + self.length <= to[j] + size[j]
            own = np.where(whole, doc[j], none)
            starts = np.flatnonzero(new)
            if not len(starts) or starts[0]:  # the open run goes on
                n = int(starts[0]) if len(starts) else len(at)
                open_.put(at[:n][whole[:n]], own[:n][whole[:n]])
                least = min(least, int(own[:n].min()))
                if not len(starts):
                    continue
            close()
            runs = np.minimum.reduceat(own, starts)
            last = int(starts[-1])
            of = np.repeat(runs[:-1], np.diff(starts))
            inner, theirs = at[starts[0] : last], own[starts[0] : last]
            hit[inner[whole[starts[0] : last] & (theirs > of)]] = True
            open_.put(at[last:][whole[last:]], own[last:][whole[last:]])
            least = int(runs[-1])
        close()
        return hit


def _found(blobs: DataFrame, shards: int, length: int, memory: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(shard: Shard) -> Iterator[pa.RecordBatch]:
            for x in shard.repeats():
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, j])) for j in range(4)], names=["doc_id", "text_hash", "lo", "hi"])

        now, shard = None, None
        for batch in batches:
            for number, blob in zip(batch.column("shard").to_pylist(), batch.column("blob"), strict=True):
                if number != now:
                    if shard:
                        yield from told(shard)
                    now, shard = number, Shard(length, memory)
                shard.add(_unpacked(blob.as_buffer().to_pybytes()))
        if shard:
            yield from told(shard)

    dealt = blobs.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "doc_id long, text_hash long, lo long, hi long")


def _merged(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): each document's maximal runs, as pairs of
    little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, spans, out = None, [], []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["doc_id", "text_hash", "spans"])

        for batch in batches:
            for i, h, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (i, h) != doc:
                    if doc:
                        out.append((*doc, np.array(spans, np.int64).tobytes()))
                    if len(out) >= 1000:
                        yield made()
                    doc, spans = (i, h), [[lo, hi]]
                elif lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
        if doc:
            out.append((*doc, np.array(spans, np.int64).tobytes()))
        yield made()

    return found.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "lo").mapInArrow(run, "doc_id long, text_hash long, spans binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """Remove bytes of ``length``-byte strings that also start in a document
    with a smaller id: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Every window of ``length`` bytes is keyed by the least hash of the strings
    of GRAM bytes in it, and stretches of windows of one key are dealt to shards
    by it, so equal windows of all documents meet.  A shard leaves out keys that
    one document has, aggregates equal stretches (told by 128-bit hashes; larger
    documents lose them) and sorts the suffixes of all others by recursive
    induction (see :mod:`induced`), which carries common prefixes along, with
    ``memory`` bytes of queues and sort runs and all else on disk.  Runs of
    suffixes that share ``length`` bytes give the windows that a smaller document
    holds.  Strings are judged on the input, overlaps included, and never cross
    documents.

    Null texts are empty.  Rows with a null id keep all their bytes and are not
    held against others; rows with equal ids are not held against each other.
    One row for each input row; an empty table gives an empty result; other
    columns, whatever their names, are ignored.  Ids are whole numbers.  A very
    long text is cut into stretches by one task.
    """
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count()
    # only where ids are repeated must texts of one id be told apart
    text_hash = F.xxhash64(text_col) if repeated else F.lit(0).cast("long")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash.alias("text_hash"), F.col(text_col).alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, min(MOST_SHARDS, 4 * total // SHARD_BYTES))
    spans = staged(_merged(_found(_segments(own.select("doc_id", "text_hash", F.encode("text", "UTF-8").alias("text")), shards, length), shards, length, memory)), "repeat-spans")
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("spans")), F.lit(0))).first()
    side = F.broadcast(spans) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else spans

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: list[list] = [[], [], [], []]
            for text, pairs in zip(batch.column("text"), batch.column("spans"), strict=True):
                text = text.as_buffer() if text.is_valid else memoryview(b"")
                runs = np.frombuffer(pairs.as_buffer(), np.int64).reshape(-1, 2).tolist() if pairs.is_valid else []
                view, kept, at = memoryview(text), hashlib.sha256(), 0
                for lo, hi in runs:
                    kept.update(view[at:lo])
                    at = hi
                kept.update(view[at:])
                for column, value in zip(told, (len(view), sum(hi - lo for lo, hi in runs), len(runs), kept.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in told[:3]), pa.array(told[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = own.join(side, ["doc_id", "text_hash"], "left").select("doc_id", F.encode("text", "UTF-8").alias("text"), "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: All windows of the query's length, told by the smallest document of each.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT r, doc_id, o, substr(x, 2 * o + 1, {2 * (512 + LENGTH - 1)}) AS x FROM (SELECT r, doc_id, x, unnest(range(0, len(x) // 2, 512)) AS o FROM d)),
w AS (SELECT r, doc_id, o + i AS i, substr(x, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT r, doc_id, o, x, unnest(range(len(x) // 2 - {LENGTH} + 1)) AS i FROM part)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, i FROM w JOIN f USING (s) WHERE doc_id > first),
run AS (SELECT r, min(i) AS lo, max(i) + {LENGTH} AS hi FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY r, k),
edge AS (SELECT r, lo, hi FROM run UNION ALL SELECT r, len(x) // 2, len(x) // 2 FROM d),
kept AS (SELECT r, string_agg(substr(x, 2 * coalesce(before, 0) + 1, 2 * (lo - coalesce(before, 0))), '' ORDER BY lo) AS x FROM (
  SELECT r, lo, lag(hi) OVER (PARTITION BY r ORDER BY lo, hi) AS before FROM edge) JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM run GROUP BY r) USING (r)
"""
