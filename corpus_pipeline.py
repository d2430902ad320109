"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, then token ids.

Each stage takes (spark, docs, sf_dir), docs being all rows that the stage before it kept,
and returns a DataFrame; all but the last return the columns of documents, extra ones too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontaminate, near_copies, secrets, toxicity
from tessella.llm.common import table, written

RANKS = "byte_bpe_50k.tiktoken"
ORACLE_SQL = None  # hashes, training and token ids are beyond SQL; see tests/llm/test_pipeline.py


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxicity.THRESHOLD or more go; null and empty texts stay."""
    scorer = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, scorer)
    return scored.where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the least id stays."""
    return near_copies.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by the name of its kind in brackets; n_chars follows the text."""
    clean = secrets.redact(docs, secrets.find_secrets(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids, which decode to the text's bytes."""
    encoded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
