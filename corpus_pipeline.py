"""A corpus from raw documents: rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the cluster's shared folder and reads it again as the
next stage's documents. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import bpe, mixing, neardup, pii, rules
from stratalog.llm.common import ensure_checkpoint_dir, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.quality_rules(docs.select(COLUMNS)).where("rules.kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more), the one with the smallest id."""
    return neardup.deduplicated(docs.select(COLUMNS), percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked, disclosing terms generalised or removed; n_chars follows the text."""
    found = pii.personal_data(docs.select(COLUMNS))
    clean = F.when(F.col("text").isNotNull(), pii.sanitised(F.col("text"), F.col("pii")))
    return found.withColumn("text", clean).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs.select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return bpe.digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


#: SQL can't express byte-pair merges or HyperMinHash buckets; the tests hold the stages against plain versions.
ORACLE_SQL = None
