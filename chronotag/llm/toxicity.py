"""Toxicity scores from a learned, weighted lexicon."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.llm.common import staged

#: Labelled documents that the lexicon is learned from, at most (expected number).
LABELLED = 20_000
#: Look-alikes of Latin letters, and digits written for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝкмтвнгαοεικνρτυχηωıʟɡ", "aeopcyxijshdqwkmtbhraoeiknptyxnwilg", strict=True))
DIGITS = dict(zip("013457@", "oieasta", strict=True))
DOLLAR = re.compile(r"(?<=[^\W\d_])\$(?=[^\W\d_])")
SHORTEST, LONGEST = 4, 12
LEAST_DOCS, LEAST_Z, LEAST_WEIGHT = 5, 5.0, 1.5
#: What a pattern must weigh before the phrases that excuse it are known.
FIRST_WEIGHT = 0.7
SEGMENT = 1 << 20


class _Fold(dict):
    """Code point -> folded letter, or a space for what is not a letter."""

    def __missing__(self, point: int) -> str:
        c = chr(point).lower()
        c = DIGITS.get(c) or HOMOGLYPHS.get(c) or unicodedata.normalize("NFKD", c)[0]
        c = HOMOGLYPHS.get(c, c)
        self[point] = out = c if c.isalpha() else "" if unicodedata.combining(c) or unicodedata.category(chr(point)) == "Cf" else " "
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Letters without case, accents, look-alikes and digit spellings; all
    else is a space, but invisible marks, which vanish."""
    if "$" in text:
        text = DOLLAR.sub("s", text)
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    """Patterns begin a word; those ending in a space are whole words.

    ``exceptions`` are words or word pairs in which a pattern does not count.
    """

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    model: list[float] = field(default_factory=list)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(" " + p, (len(p) + 1, w))
        for p in self.exceptions:  # may extend a pattern, never equal it
            a.add_word(f" {p} ", (len(p) + 2, 0.0))
        a.make_automaton()
        return a


def _segments(text: str) -> Iterator[str]:
    """Pieces of about SEGMENT characters, each but the first from a space on."""
    at = 0
    while len(text) - at > SEGMENT:
        end = text.rfind(" ", at + 1, at + SEGMENT)
        end = end if end > 0 else text.find(" ", at + SEGMENT)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def hits(automaton, text: str) -> tuple[list[tuple[int, float]], int]:
    """(position, weight) of the patterns outside exception phrases, and the
    number of words.

    Positions are those in the folded words with one space between them.  A very
    long text is folded piece by piece, and the automaton keeps its state from
    one to the next, so phrases are found wherever they lie.
    """
    found, excused, n_words, search = [], [], 0, None
    for segment in _segments(text):
        words = fold(segment).split()
        n_words += len(words)
        if not words or not len(automaton):
            continue
        s = " ".join(words) + " "
        if search is None:
            search = automaton.iter(" " + s)
        else:
            search.set(s, False)
        for last, (size, weight) in search:
            (found if weight else excused).append((last - size + 1, last, weight))
    if excused:
        found = _outside(found, excused)
    return [(f[0], f[2]) for f in found], n_words


def _outside(found: list[tuple], excused: list[tuple]) -> list[tuple]:
    """The spans that lie in no excused one, by one pass in order of start."""
    out, reach, i = [], -1, 0
    excused.sort()
    for span in sorted(found):
        while i < len(excused) and excused[i][0] <= span[0]:
            reach = max(reach, excused[i][1])
            i += 1
        if span[1] > reach:
            out.append(span)
    return out


def features(found: list[tuple[int, float]], n_words: int) -> tuple[float, ...]:
    total = sum(w for _, w in found)
    return 1.0, float(bool(found)), math.log1p(total), math.log1p(100 * total / max(n_words, 20)), max((w for _, w in found), default=0.0)


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5)) == 0


def _patterns(folded: str) -> set[str]:
    words = set(folded.split())
    return {f"{w} " for w in words if len(w) >= 3} | {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def _counted(docs: DataFrame, wanted: set[str] | None, near: set[str] | None = None) -> DataFrame:
    """(pattern, df): documents in which each pattern occurs; all patterns, only
    the wanted ones, or the words and word pairs around the ``near`` ones."""
    wanted_b = docs.sparkSession.sparkContext.broadcast((wanted, near))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, near = wanted_b.value
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                folded = fold(text)
                if near is None:
                    own = _patterns(folded)
                    seen.update(own if wanted is None else own & wanted)
                else:
                    words, own = folded.split(), set()
                    for i, w in enumerate(words):
                        if f"{w} " in near or any(w[:n] in near for n in range(SHORTEST, min(LONGEST, len(w)) + 1)):
                            own |= {w, " ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])}
                    seen.update(own)
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pattern", "df"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pattern", "df"])

    return docs.select("text").mapInArrow(count, "pattern string, df long").groupBy("pattern").agg(F.sum("df").alias("df"))


def _contrast(t: int, c: int, n_t: int, n_c: int) -> tuple[float, float]:
    """Log odds ratio and z of a pattern in t of n_t and c of n_c documents."""
    ratio = math.log((t + 0.5) / (n_t + 1)) - math.log((c + 0.5) / (n_c + 1))
    expected = (t + c) * n_t / (n_t + n_c)
    return ratio, (t - expected) / math.sqrt(expected + 1e-9)


def learn(sample: DataFrame, least_docs: int = LEAST_DOCS) -> Lexicon:
    """Fit patterns, exceptions and the score on rows of (text, toxic)."""
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    n_t, n_c = toxic.count(), clean.count()
    if not n_t or not n_c:
        return Lexicon()
    least = max(least_docs, n_t // 400)
    in_toxic = {r.pattern: r.df for r in _counted(toxic, None).where(F.col("df") >= least).collect()}
    in_clean = {r.pattern: r.df for r in _counted(clean, set(in_toxic)).collect()}
    told = sorted(((*_contrast(t, in_clean.get(p, 0), n_t, n_c), p) for p, t in in_toxic.items()), key=lambda x: (-x[1], len(x[2]), x[2]))
    weights: dict[str, float] = {}
    taken: set[str] = set()
    for weight, z, p in told:
        if z < LEAST_Z or weight < FIRST_WEIGHT:
            continue
        if any(p[:n] in weights for n in range(SHORTEST, len(p))) or p in taken:
            continue  # a stem of it counts already, or it is the stem of one that does
        weights[p] = weight
        taken |= {p.rstrip()[:n] for n in range(SHORTEST, len(p.rstrip()) + 1)}
    lexicon = Lexicon(weights)
    around_t, around_c = ({r.pattern: r.df for r in _counted(d, None, set(weights)).where(F.col("df") >= 3).collect()} for d in (toxic, clean))
    for phrase, c in around_c.items():
        if _contrast(around_t.get(phrase, 0), c, n_t, n_c)[0] < -1 and phrase + " " not in weights:
            lexicon.exceptions.append(phrase)
    lexicon.exceptions.sort()
    outside = _outside_exceptions(sample, lexicon)
    weighed = {p: _contrast(outside.get((p, 1), 0), outside.get((p, 0), 0), n_t, n_c) for p in weights}
    lexicon.weights = {p: w for p, (w, z) in weighed.items() if w >= LEAST_WEIGHT and z >= LEAST_Z}
    lexicon.model = _fit(sample, lexicon)
    return lexicon


def _outside_exceptions(sample: DataFrame, lexicon: Lexicon) -> dict[tuple[str, int], int]:
    """Documents per pattern and label in which the pattern counts."""
    names = list(lexicon.weights)
    numbered = Lexicon({p: float(i + 1) for i, p in enumerate(names)}, lexicon.exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = numbered.automaton(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update({(int(w) - 1, toxic) for _, w in hits(automaton, text)[0]})
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], pa.int32()) for i in (0, 1)] + [pa.array(seen.values(), pa.int64())], names=["pattern", "toxic", "df"])

    rows = sample.select("text", "toxic").mapInArrow(run, "pattern int, toxic int, df long").groupBy("pattern", "toxic").agg(F.sum("df").alias("df")).collect()
    return {(names[r.pattern], r.toxic): r.df for r in rows}


def _fit(sample: DataFrame, lexicon: Lexicon) -> list[float]:
    """Logistic regression of the label on the features, by Newton steps."""
    rows = np.array(_features_of(sample, lexicon).select("f", "toxic").toPandas().apply(lambda r: [*r["f"], r["toxic"]], axis=1).tolist())
    x, y, w = rows[:, :-1], rows[:, -1], np.zeros(rows.shape[1] - 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
    return w.tolist()


def _features_of(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            values = []
            for i in range(0, len(batch), 512):
                values += [features(*hits(automaton, t or "")) for t in batch.column(at).slice(i, 512).to_pylist()]
            kept = [batch.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.list_(pa.float64()))], names=[*(f.name for f in others), "f"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(run, f"{schema}, f array<double>")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learn from labelled documents that are not held out.

    At most about ``labelled`` rows are used, chosen by a hash of their id, with
    their whole texts.  Labels that are null or whose text is missing teach
    nothing; where no label of either kind is left, as in empty tables, the
    lexicon is empty.  Repeated rows count each time; other columns are ignored.
    """
    rows = labels.select(F.col(id_col).alias("_id"), "toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col(id_col)))
    n = rows.count()
    share = min(1.0, labelled / max(n, 1))
    rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))  # at most about `labelled` rows
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(rows), "_id").select("text", "toxic")
    return learn(staged(sample.repartition(max(1, min(n, labelled) // 1000)), "toxicity-sample"))


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: (doc_id, held_out, score, predicted).

    Weighted patterns are found by one Aho-Corasick pass over the folded text,
    except inside exception phrases; their weights, in total and per word, give
    the score.  Null and empty texts have no hits; with an empty lexicon the
    score is 0.  A very long text is folded piece by piece, with the same result
    as at once.  One row for each input row, repeated rows and null ids (never
    held out: null) included; an empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    x = _features_of(own, lexicon)
    z = sum((F.get("f", F.lit(i)) * w for i, w in enumerate(lexicon.model)), F.lit(0.0))
    score = 1 / (1 + F.exp(-z)) if lexicon.model else F.lit(0.0)
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`toxicity` predicts 0 for.

    Rows are judged one by one, so repeated rows, null ids and columns of any
    name are kept as they are; null and empty texts are clean; an empty table
    gives an empty one; with an empty lexicon all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, model = shared.value.automaton(), np.array(shared.value.model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            keep: list[bool] = []
            for i in range(0, len(batch), 512):
                for t in texts.slice(i, 512).to_pylist():
                    keep.append(not len(model) or float(model @ np.array(features(*hits(automaton, t or "")))) < 0)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
