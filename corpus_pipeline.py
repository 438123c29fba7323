"""The corpus pipeline: quality rules, exact and near deduplication, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the columns of
documents. run() writes each stage's result as Parquet into the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimap.llm.common import materialise, table
from evimap.llm.exact_dedup import drop_exact_duplicates
from evimap.llm.near_dedup import drop_near_duplicates
from evimap.llm.packing import pack
from evimap.llm.pii import sanitise
from evimap.llm.quality import keep_good
from evimap.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack(docs, tokenizer("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("personal data", private), ("packing", packed)]

#: Alignment, mutual information and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
