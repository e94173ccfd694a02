import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Seeded invented prose: prose(words, seed)."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice(["ba", "ko", "ti", "re", "na", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def edges(spark, prose):
    """Nulls, empty, long and repeated rows, and columns with inner names."""
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y z"), (None, None), (4, prose(60_000, 1)), (5, "  \n\t "), (6, "é ñ 𝒳 \x00 \x1c end"), (7, prose(300, 2)), (8, prose(300, 2))]
    clash = "text_hash h size c n token r w _id _hash _cut _gone _d row pid shard spans tags hash value block list repo owner base any start end is kind from to component node comp length sequence_id".split()
    return spark.createDataFrame([(*r, None, None, *("z" for _ in clash)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash))


@pytest.fixture(scope="session")
def none(edges):
    return edges.limit(0)
