"""A corpus made ready for training: quality rules, exact and near deduplication, mixing, and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from tendon.llm.shared import saved

#: Near copies: Jaccard similarity of the sets of five words.
SHINGLE, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, all rows and columns as they are; a null text has no words and goes."""
    return quality_rules.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id, whatever the other columns; null ids lose, and of several rows with
    that id and text the first by its contents stays."""
    return exact_dedup.deduplicated(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the one with the smallest id; rows without an id stay. Short texts are compared as one shingle."""
    return simhash.one_of_each(docs, shingle=SHINGLE, similarity=SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whole passes and runs of words, by the weights of their sources; a null source is one of its own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the hash of the bytes they decode to; repeated ids are rows like any other."""
    rows = bpe.encoded(docs, decode=True)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("byte-level bpe", encode)]

#: SimHash fingerprints and BPE are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
