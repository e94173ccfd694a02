"""A corpus pipeline of five of the operators; each stage rereads the last one's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotag.llm import decontam, jaccard, packing, secrets, toxicity
from chronotag.llm.common import scope, staged, table
from chronotag.llm.registry import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from ``labels`` does not call toxic.

    Null and empty texts are clean; without usable labels all documents stay.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 5-word
    shingles at a similarity of 0.8 and more.

    Texts without words and rows without an id are in no group and stay; of rows
    with one id one stays.
    """
    return jaccard.keep_representatives(docs, jaccard.Rule(5, 80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ``benchmark``; with an empty benchmark all."""
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific secrets replaced; ``n_chars`` is that of
    the new text, 0 for null."""
    out = secrets.redact_live(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 ids; a null text is
    an empty one."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: The stages fit a model and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents`` in order.

    Columns other than doc_id, text and source may have any names and pass
    through; an empty table gives an empty result.  What a stage staged is
    removed as soon as its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
