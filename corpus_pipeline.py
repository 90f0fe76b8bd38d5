"""A training-data pipeline over ``documents``: STAGES lists its stages in order, run() applies them.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``: toxic documents go, one document of each near-duplicate group
stays, secrets are masked in place, documents are repeated or left out to meet the sources' targets,
and what results is packed into sequences, token ids included. run() writes what each stage keeps to the
checkpoint folder, so every stage runs once however often the next one reads its result.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabassay.llm import mixing, packing, secrets, simhash, toxicity
from tabassay.llm.common import checkpointed, session, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(session(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    session(spark)
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets lose them, and n_chars follows; all other documents stay as they are."""
    masked = secrets.redact_secrets(docs.withColumn("__before", F.col("text")))
    n_chars = F.when(F.col("text").eqNullSafe(F.col("__before")), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", n_chars).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    session(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("source_mix", mix),
    ("best_fit_packing", pack),
]

#: SQL can't express the first, second and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
