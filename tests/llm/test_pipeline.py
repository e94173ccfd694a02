"""The pipeline and the registered queries, on the smallest tables."""

import collections
import struct
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chronotag.llm import registry
from chronotag.llm.common import staged, table

from .test_text_operators import brute_components, brute_contamination, brute_spans

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    norm = lambda df: df[sorted(df.columns)].astype(str).replace({"<NA>": "None", "nan": "None"}).sort_values(sorted(df.columns)).reset_index(drop=True)
    assert norm(registry.QUERIES[name](spark, DATA).toPandas()).equals(norm(con.sql(registry.ORACLES[name]).df()))


def test_stages_on_edge_rows_and_nothing(spark, edges, none):
    """Nulls, empty, long and repeated rows, clashing columns, empty tables."""
    kept = {"toxicity": 11, "near_duplicates": 9, "decontamination": 11, "secrets": 11}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edges, DATA)
        assert out.columns == edges.columns and out.count() == kept[name], name
        assert stage(spark, none, DATA).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, edges, DATA)
    assert pieces.where("start = 0").count() == 11 and corpus_pipeline.STAGES[-1][1](spark, none, DATA).count() == 0
    docs = edges
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, DATA), name)
    assert docs.where("start = 0").count() == 9


def test_every_stage_does_its_part(spark):
    docs = table(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, DATA), name)
        assert docs.columns == before.columns
        seen[name] = [tuple(r) for r in before.select("doc_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()]
    before, after = seen["toxicity"]
    told = {r.doc_id: r.predicted for r in registry.QUERIES["op1_toxicity"](spark, DATA).collect()}
    assert sorted(d for d, _ in after) == sorted(d for d, _ in before if not told[d])
    before, after = seen["near_duplicates"]
    assert sorted(d for d, _ in after) == [d for d, _, c in sorted(brute_components(before, 5, 80, 100)) if d == c]
    before, after = seen["decontamination"]
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    assert sorted(d for d, _ in after) == sorted(w[0] for w in brute_contamination(before, items) if not w[5])
    before, after = seen["secrets"]
    assert len(before) == len(after)
    now = dict(after)
    assert all(now[d] == t or brute_spans(t) or "[secret]" in now[d] for d, t in before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    tokenizer, want = Tokenizer.from_file(registry.tokenizer_path()), collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            want[(r.doc_id, at, zlib.crc32(struct.pack(f"<{len(ids[at : at + 2048])}I", *ids[at : at + 2048])))] += 1
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in packed.collect()) == want
