"""Language identification by cross-parsing against labelled text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotag.llm.toxicity import held_out

#: Labelled documents that are looked at per language (expected number), the
#: characters that such a document has at most, and the letters from which on a
#: language has enough whole documents.
TRAIN_DOCS, TRAIN_LONGEST, TRAIN_LETTERS = 300, 8_000, 60_000
#: Letters that are parsed side by side, and the number of texts from which on
#: that is faster than one after the other.
BATCH_LETTERS, FEW_TEXTS = 1 << 23, 64
#: Entries of the table of branching states; beyond, they are looked up by search.
DENSE_ENTRIES = 1 << 25


class _Letters:
    """Code point -> lower-case letter, or 0 for what is not a letter; filled in
    as blocks of 256 code points are met."""

    def __init__(self):
        self.table = np.zeros(0x110000, np.uint32)
        self.known = np.zeros(0x1100, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        for block in np.flatnonzero(np.bincount(points >> 8, minlength=0x1100) & ~self.known):
            for p in range(block << 8, (block + 1) << 8):
                c = chr(p)
                if c.isalpha():
                    self.table[p] = ord(c.lower()[0])
            self.known[block] = True
        return self.table[points]


_letters = _Letters()


def letter_stream(text: str | None) -> np.ndarray:
    """The letters of a text in lower case, with 0 before, between and after
    words; empty where there is no letter (``str.isalpha``)."""
    folded = _letters(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32))
    letter = folded > 0
    if not letter.any():
        return folded[:0]
    after = np.concatenate([[False], letter[:-1]])
    out = folded[letter | after]
    return np.concatenate([np.zeros(1, np.uint32), out, np.zeros(int(out[-1] != 0), np.uint32)])


class SuffixAutomaton:
    """All substrings of a sequence; state 0 is the empty one."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, sequence: list[int], state: int = 0) -> int:
        """The number of longest-match phrases that begin in ``sequence``, parsed
        from a state on; a symbol that occurs nowhere is a phrase of its own."""
        step, root, n = self.next, self.next[0], 0
        for c in sequence:
            to = step[state].get(c)
            if to is None or not state:
                n += 1
                to = root.get(c, 0)
            state = to
        return n


class Model:
    """An automaton per language, parsed for many texts at a time."""

    def __init__(self, texts: dict[str, np.ndarray]):
        """``texts`` has the letter streams learned per language."""
        self.langs = sorted(texts)
        # a phrase costs its pointer into the text: log2 of the text's length
        self.cost = np.array([np.log2(max(2, len(texts[x]))) for x in self.langs])
        alphabet = np.unique(np.concatenate([texts[x] for x in self.langs])) if texts else np.empty(0, np.uint32)
        self.symbols = np.zeros(0x110000, np.int32)  # 0 is a symbol that no language has
        self.symbols[alphabet] = np.arange(1, len(alphabet) + 1)
        self.size = len(alphabet) + 1
        self.automata = [SuffixAutomaton(self.symbols[texts[x]].tolist()) for x in self.langs]
        first = np.cumsum([0, *(len(a.next) for a in self.automata)])
        self.roots = first[:-1].astype(np.int32)
        n = int(first[-1])
        # each state's first edge, and the others by a row for each branching state
        self.symbol, self.to, self.row = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32)
        branching, keys, ends = 0, [], []
        for root, a in zip(self.roots.tolist(), self.automata, strict=True):
            for i, edges in enumerate(a.next, root):
                if not edges:
                    continue
                c, to = next(iter(edges.items()))
                self.symbol[i], self.to[i] = c, to + root
                if len(edges) > 1:
                    self.row[i] = branching
                    keys += [branching * self.size + c for c in edges]
                    ends += [to + root for to in edges.values()]
                    branching += 1
        keys, ends = np.array(keys, np.int64), np.array(ends, np.int32)
        self.dense = None
        if branching * self.size <= DENSE_ENTRIES:
            self.dense = np.full(max(1, branching * self.size), -1, np.int32)
            self.dense[keys] = ends
        else:
            order = np.argsort(keys)
            self.keys, self.ends = keys[order], ends[order]
        self.begin = np.repeat(self.roots[:, None], self.size, 1)  # where a phrase's first symbol leads
        for k, a in enumerate(self.automata):
            for c, to in a.next[0].items():
                self.begin[k, c] = to + self.roots[k]

    def _edge(self, row: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = row.astype(np.int64) * self.size + c
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ends[at], -1)

    def phrases(self, streams: list[np.ndarray]) -> np.ndarray:
        """Phrases of each stream (row) in each language (column).

        All streams take a step together, in all languages, until few are left;
        these are finished one by one.
        """
        sizes = np.array([len(s) for s in streams])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = self.symbols[np.concatenate([streams[i] for i in order])] if len(order) else np.empty(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        state = np.repeat(self.roots[:, None], len(order), 1)
        count = np.zeros(state.shape, np.int64)
        t = 0
        while t < sizes[0] if len(sizes) else False:
            active = int(np.searchsorted(-sizes, -t))  # those longer than t
            if active < FEW_TEXTS:
                break
            c = flat[starts[:active] + t]
            now = state[:, :active]
            to = np.where(self.symbol[now] == c, self.to[now], -1)
            k, i = np.nonzero(to < 0)
            row = self.row[now[k, i]]
            more = np.flatnonzero(row >= 0)
            to[k[more], i[more]] = self._edge(row[more], c[i[more]])
            new = (to < 0) | (now == self.roots[:, None])
            count[:, :active] += new
            k, i = np.nonzero(new)
            to[k, i] = self.begin[k, c[i]]
            state[:, :active] = to
            t += 1
        for i in range(int(np.searchsorted(-sizes, -t)) if len(sizes) else 0):
            rest = flat[starts[i] + t : starts[i] + sizes[i]].tolist()
            for k, a in enumerate(self.automata):
                count[k, i] += a.phrases(rest, int(state[k, i] - self.roots[k]))
        out = np.empty((len(order), len(self.langs)), np.int64)
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) for each text, in batches of bounded size."""
        out: list[tuple[str, float]] = []
        streams: list[np.ndarray] = []
        held = 0
        for text in texts:
            streams.append(letter_stream(text))
            held += len(streams[-1])
            if held >= BATCH_LETTERS:
                out += self._told(streams)
                streams, held = [], 0
        return out + self._told(streams)

    def _told(self, streams: list[np.ndarray]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(streams)
        some = [i for i, s in enumerate(streams) if len(s)]
        if not self.langs or not some:
            return out
        for i, bits in zip(some, self.phrases([streams[i] for i in some]) * self.cost, strict=True):
            best, words = int(bits.argmin()), int((streams[i] == 0).sum()) - 1
            out[i] = self.langs[best], float(1 / np.exp2(np.clip((bits[best] - bits) / np.sqrt(words), -60, 0)).sum())
        return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, longest: int = TRAIN_LONGEST, letters: int = TRAIN_LETTERS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The letter streams learned per language, from documents not held out.

    About ``train_docs`` labelled documents per language, of at most ``longest``
    characters (or a language's shortest one, where all are longer), are chosen
    by a hash of their id; of these, whole documents are taken until they have
    ``letters`` letters.  Lines that another language parses better are left
    out, as labelled documents quote other languages.  Null texts, ids and
    labels teach nothing; an empty table teaches no language.
    """
    size = F.length("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = {r.lang: r for r in rows.groupBy("lang").agg(F.count_if(size <= longest).alias("short"), F.min(size).alias("least")).collect()}  # a row for each language
    if not counts:
        return {}
    limit = F.coalesce(*(F.when(F.col("lang") == x, F.lit(max(longest, r.least))) for x, r in counts.items()))
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, train_docs / max(1, r.short)))) for x, r in counts.items()))
    chosen = rows.where((size <= limit) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)).select("lang", "text", F.xxhash64("id").alias("h"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = chosen.withColumn("n", first).where(F.col("n") <= 2 * train_docs).drop("n")  # equal ids have equal hashes
    lines: dict[str, list[str]] = {x: [] for x in counts}
    held = dict.fromkeys(counts, 0)
    for r in sorted(chosen.collect(), key=lambda r: (r.h, r.text)):
        if held[r.lang] < letters:
            lines[r.lang] += r.text.split("\n")
            held[r.lang] += int((letter_stream(r.text) > 0).sum())

    def joined(part: dict[str, list[str]]) -> dict[str, np.ndarray]:
        streams = {x: [s for s in map(letter_stream, v) if len(s)] for x, v in part.items()}
        return {x: np.concatenate([v[0], *(s[1:] for s in v[1:])]) for x, v in streams.items() if v}

    half = {x: v[::2] for x, v in lines.items()}, {x: v[1::2] for x, v in lines.items()}
    models = [Model(joined(h)) for h in half]
    kept: dict[str, list[str]] = {}
    for k, part in enumerate(half):  # each half is judged by the other
        for x, v in part.items():
            told = models[1 - k].predict(v)
            kept.setdefault(x, []).extend(line for line, (best, _) in zip(v, told, strict=True) if best == x or not models[1 - k].langs)
    return joined({x: v or lines[x] for x, v in kept.items()})


_models: dict[int, Model] = {}


def identify(docs: DataFrame, texts: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every whole text.

    The text's letters, with one space between words, are parsed from end to end
    into longest matches of each language's learned text.  The language with the
    fewest phrases, weighed by the cost of a phrase, wins; ties go to the smaller
    name.  ``und`` with score 0 where the text is null or has no letter, or
    nothing was learned.  One row for each input row, repeated rows and null ids
    (never held out: null) included; an empty table gives an empty result; other
    columns, whatever their names, are ignored.  A very long text is parsed
    whole by one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    kind = docs.schema[id_col].dataType.simpleString()
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else id(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = Model(shared.value)
        for batch in batches:
            told = _models[key].predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
