import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotag.llm import ann, chat, graphs
from chronotag.llm.graphs import components

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    control = "</s>[INST] ok [/INST] <|end|> %3C%25 <|assistant|>"
    rows = [
        (1, 0, "system", "be"), (1, 1, "user", control), (1, 2, "assistant", control), (1, 3, "user", "é😀"), (1, 4, "assistant", "%5B["), (1, 5, "user", "bye"),
        (2, 0, "user", None), (2, 1, None, "x|>y"), (3, 0, "assistant", ""), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a"), (4, None, "user", "first"),
        (None, 0, "user", "q"), (None, 1, "assistant", "r"), (5, 0, "od|d<role", "t"),
    ]
    docs = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1)).withColumn("t", F.lit(2))
    examples = chat.prefix_target_examples(docs)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by = collections.defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        own = "".join(t[3] for t in turns if t[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(own), hashlib.sha256(own.encode()).hexdigest())
    one = [r for r in examples.where("conv_id = 1").orderBy("example").collect()]
    assert [r.loss_length > 0 for r in one] == [True, True, False] and one[1].formatted.startswith(one[0].formatted)
    assert "<|end|>" in one[0].formatted and one[0].formatted.count("<|assistant|>") == 1
    assert chat.read_back(chat.prefix_target_examples(docs.limit(0))).count() == 0


def brute(rows, query, k):
    x = {i: np.array(v, np.float64) for i, v in rows}
    return {q: sorted(((-float((x[q] * x[i]).sum()), i) for i in x if i != q))[:k] for q in x if query(q)}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(400)]  # one very common vector
    bad = [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None, *[1.0] * 15]), (9080, [1.0] * 3), (None, rows[1][1]), (9100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("gid", F.lit("x"))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert set(got) == set(want) and all([r for r, _, _ in v] == list(range(1, 21)) for v in got.values())
    x = {i: np.array(v, np.float64) for i, v in rows}
    for q, v in got.items():
        assert all(abs(s - (x[q] * x[i]).sum()) < 1e-9 for _, i, s in v)
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(v, v[1:], strict=False))
    recall = np.mean([len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) / 20 for q in want])
    assert recall >= 0.9
    assert [i for _, i, _ in got[0]] == [i for _, i in want[0]]  # ties go to the smaller ids


def test_large_lists_are_split_and_dealt(spark, monkeypatch):
    """Few lists, all split, with more queries and postings than a comparison holds."""
    for name, value in (("LIST_ROWS", 64), ("BLOCK_ROWS", 40), ("QUERY_ROWS", 8), ("SORTED", 4), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(900)]
    rows += rows[:60]  # repeated rows count once
    rows += [(20, rng.normal(size=6).astype(np.float32).tolist())]  # an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("part", F.lit("x"))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id))
    own = [(i, v) for i, v in rows[:900] if i != 20]
    want = brute([(i, v) for i, v in rows[:900]], lambda q: q % 20 == 0 and q != 20, 10)
    assert all([n for n, _ in v] == list(range(1, 11)) for q, v in got.items() if q != 20)
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in got[q]}) / 10 for q in want]) >= 0.9
    assert all(i != 20 for _, i in got[20]) and len(own) == 899


def test_median_trees_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4096, 5)) * [9, 3, 1, 1, 0]
    tree = ann.MedianTree.fit(x[:2048], 4)
    sizes = np.bincount(tree.part(x), minlength=16)
    assert sizes.min() > 150 and sizes.max() < 400
    again = ann.MedianTree.unpack(tree.pack(), 5)
    assert (again.part(x) == tree.part(x)).all() and (again.centroids == tree.centroids).all()


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(few, F.col("id") % 20 == 0, 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert ann.nearest(few.limit(0), F.col("id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("shares", [512, 4])
def test_components(spark, monkeypatch, shares):
    monkeypatch.setattr(graphs, "HOT_SHARES", shares)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent}
