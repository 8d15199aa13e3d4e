"""A corpus pipeline of stages over ``documents``; each stage's result is written and read again.

Quality classifier, near-duplicate removal, benchmark decontamination, pseudonyms for personal data,
byte-level BPE. Every stage reads all that the one before kept; whatever a stage decides takes effect in its result.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm import bpe, contamination, ngramjoin, pii, quality, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more; null and empty texts are scored like others."""
    model = queries.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, "text", model, COLUMNS).filter("score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 on runs of five words, the one of smallest id.

    Documents are told apart by id and text, so of different texts under one id each is judged by itself. Documents without words, and rows
    without an id, stay. Of rows with the same id and the same text one stays.
    """
    docs = docs.withColumn("h", F.xxhash64("text"))
    named = docs.filter("doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").limit(1).count()
    # ids that name one text each are lighter to move than ids with a digest
    keys = ["doc_id", "h"] if several else ["doc_id"]
    own = [F.col(f"id.{k}") for k in keys] if several else [F.col("id").alias("doc_id")]
    found = ngramjoin.components(named.select(F.struct(*keys).alias("key") if several else F.col("doc_id").alias("key"), "text"), "key", "text", n=5, percent=80)
    gone = found.filter(F.col("id") != F.col("component")).select(*own).distinct()
    repeated = found.filter("size > 0 AND id = component").groupBy("id").count().filter("count > 1").select(*own)
    left = docs.join(gone, keys, "left_anti")
    if not repeated.limit(1).count():
        return left.select(*COLUMNS)
    again = left.join(repeated, keys, "left_semi").dropDuplicates(keys).select(*COLUMNS)
    return left.join(repeated, keys, "left_anti").select(*COLUMNS).unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark passages. Null texts have none and stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.match(docs, "text", items, "item_id", "text", COLUMNS)
    return contamination.contaminated(found).filter(~F.col("contaminated")).select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal numbers, dates and addresses replaced; n_chars follows the text."""
    made = pii.pseudonymise(docs.select(*COLUMNS), "text", key=queries.PII_KEY, found="n_values")
    return made.withColumn("n_chars", F.when(F.col("n_values") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with digests of the ids and of what they decode to."""
    return bpe.encode(docs, "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "lang", "source"],
                      ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("pii", pseudonymise), ("bpe", tokenise)]

#: SQL cannot say the learned classifier; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Intermediate tables go to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    top = os.path.join(folder, f"corpus-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{top}/{k}-{name}")
            docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
