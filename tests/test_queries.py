import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from chronotag.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(spark_rows, duck_rows):
    norm = lambda df: df[sorted(df.columns)].round(9).astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)
    return norm(spark_rows).equals(norm(duck_rows))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert same(queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_index_stands_without_the_corpus_operators(tmp_path):
    """The rest imports, and has its queries, when the optional parts are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['chronotag.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(k.startswith('op1') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
