"""From raw documents to packed training sequences.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's ``docs``.  All but the last keep the
columns of ``documents``:

1. ``language_id`` drops documents without a letter and those whose two best languages compress
   them alike;
2. ``exact_dedup`` keeps one row of those whose texts agree but for white space, whatever their ids;
3. ``near_dedup`` keeps the smallest doc_id of each group of near duplicates;
4. ``substring_dedup`` cuts passages of 13 words and more that a document with a smaller doc_id has;
5. ``packing`` tokenises what is left and returns the pieces of the packed sequences.

Every stage takes null ids and texts, empty tables and further columns, as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact, langid, minhash, packing, registry, substring
from plumbline.llm.common import Tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.language_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, registry.tokenizer(registry.BYTE_BPE))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

# compression, MinHash and the tokenizer are not SQL; tests hold the result against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark)
    for _, stage in STAGES[:-1]:
        docs = tables.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
