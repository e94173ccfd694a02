"""Best-fit-decreasing packing of tokenized documents."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.llm.common import staged

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one task packs; padding no longer falls when there are more.
PIECES_PER_TASK = 1 << 17
#: Chunks of text whose ids a worker remembers, and characters taken at a time.
CACHED_CHUNKS, SEGMENT = 600_000, 1 << 20
#: Characters that Python splits at and the tokenizer does not take for space.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
_SPACE = re.compile(r"\s")
#: Chunks of ASCII and precomposed Latin letters, whose normal form is their
#: lower case; others are left to the tokenizer's own normalizer.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[!-~{_LATIN}]+")
#: The tokenizer's own pattern, for lower-case plain chunks.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")


#: How a tokenizer that can be asked chunk by chunk treats a text.
_CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class ChunkTokenizer:
    """Ids of whole texts, by space-free chunks that are tokenized once.

    Tokenizers as _CHUNKED drop white space and no token, normal form or pattern
    of theirs reaches across, so a text's ids are those of its chunks in order.
    Any other tokenizer is given whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.chunked = all(told[k] == v for k, v in _CHUNKED.items()) and all(t["content"].startswith("<|") for t in told["added_tokens"])
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # byte-level alphabet: printable bytes stand for themselves, others for what follows U+0100
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SEGMENT:
            cut = _SPACE.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if not self.chunked or _ODD_SPACE.search(text):
                out.append(self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            parts = []
            for segment in self._segments(text) if len(text) > SEGMENT else (text,):
                chunks = segment.split()
                self._learn(set(chunks))
                parts.append(b"".join(map(self.cache.__getitem__, chunks)))
            out.append(b"".join(parts))
        return out

    def _learn(self, chunks: set[str]) -> None:
        for kept in (self.cache, self.words):
            if len(kept) > CACHED_CHUNKS:  # forget the half that has been there longest
                for key in list(kept)[: CACHED_CHUNKS // 2]:
                    del kept[key]
        for chunk in chunks.difference(self.cache):
            if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
                self.cache[chunk] = b"".join(self.words.get(w) or self._word(w) for w in _WORDS.findall(chunk.lower()))
            else:
                self.cache[chunk] = self._bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        out = self.words[word] = self._bytes([t.id for t in self.tokenizer.model.tokenize(spelled)])
        return out


class TightestFit:
    """A segment tree over remaining capacities that finds the tightest window.

    A leaf for each capacity counts the open windows that have just that much
    left; a query walks to the first filled leaf from the wanted length on.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}
        self.windows = 0

    def _add(self, left: int, by: int) -> None:
        i = self.size + left
        while i:
            self.filled[i] += by
            i >>= 1

    def _first(self, least: int) -> int:
        """The smallest remaining capacity >= least with a window, or -1."""
        i = self.size + least
        if self.filled[i]:
            return least
        while i > 1:
            if not i & 1 and self.filled[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.filled[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """The window for a piece and the piece's offset in it."""
        left = self._first(length)
        if left < 0:
            window, left = self.windows, self.capacity
            self.windows += 1
        else:
            window = self.open[left].pop()
            self._add(left, -1)
        if left > length:
            self.open.setdefault(left - length, []).append(window)
            self._add(left - length, 1)
        return window, self.capacity - left


_workers: dict[str, ChunkTokenizer] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole documents and cut them into full windows and a rest.

    Returns doc_id, start, length, ids_crc32 and doc_tokens per piece.  A null
    text is empty, so its only id is the end id.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _workers.get(tokenizer_path) or _workers.setdefault(tokenizer_path, ChunkTokenizer(tokenizer_path))
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):
                rows, starts, lengths, sums, totals = [], [], [], [], []
                for row, own in enumerate(tokenizer.ids([t or "" for t in texts.slice(at, 256).to_pylist()])):
                    own += end
                    n = len(own) // 4
                    for start in range(0, n, capacity):
                        piece = memoryview(own)[4 * start : 4 * (start + capacity)]
                        rows.append(at + row), starts.append(start), lengths.append(len(piece) // 4), sums.append(zlib.crc32(piece)), totals.append(n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack tokenized documents into sequences of at most ``capacity`` ids.

    Overlong documents are first cut into full windows; what remains of every
    document is dealt evenly to tasks, and each task places its pieces longest
    first, each into the tightest open sequence that takes it.  A task holds one
    number per open sequence.  All pieces of all rows are placed, repeated rows
    and null ids included; a null text is empty; a very long text is tokenized
    whole by one task; an empty table gives an empty result; other columns of
    ``docs``, whatever their names, are ignored.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    pieces = staged(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "token-pieces")
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first = TightestFit(capacity), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [tree.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + w for w, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    # dealt evenly, not by a key; the order makes a task's result the same when it is run again
    dealt = pieces.repartition(tasks).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(fit, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
