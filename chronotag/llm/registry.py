"""The ``opN_<name>`` queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotag.llm import ann, chat, decontam, jaccard, langid, packing, secrets, sharding, substrings, toxicity
from chronotag.llm.common import table


def tokenizer_path() -> str:
    """The tokenizer's file, which every machine has in the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(packing.TOKENIZER))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), jaccard.Rule(4, 85, 100))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), 50)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.prefix_target_examples(turns))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_balanced_shards(table(spark, sf_dir, "documents"), 8)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_decontamination, op4_ann, op5_jaccard, op6_language, op7_secrets, op8_substrings, op9_chat, op10_sharding)}
ORACLES = {
    "op3_decontamination": decontam.ORACLE_SQL,
    "op5_jaccard": jaccard.ORACLE_SQL,
    "op7_secrets": secrets.ORACLE_SQL,
    "op8_substrings": substrings.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
    "op10_sharding": sharding.ORACLE_SQL,
}
