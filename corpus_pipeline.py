"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage reads what its predecessor kept, and its decision takes effect on rows, never by doc_id: all but the last
return rows of documents with the columns they came with, whatever those are called.

Results for odd input, in every stage: a null text counts as empty, and the row stays or goes as one; very long texts
are read whole; of rows that tie for staying (equal text and doc_id) the first one stays; a null doc_id is in no
training fold and stays like any other row; rows repeated in full are one after the exact stage; a label row that repeats is counted
again by quality and counted once by toxicity; an empty table gives an empty table with its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, packing, quality, simhash, toxicity
from tessera.llm.queries import tokenizer_file
from tessera.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (operator 8). An empty text has the statistics of no words and is judged by them."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic (operator 2). An empty text has one empty sentence."""
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 5): the longest original, then the smallest doc_id. Empty texts are equal."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of near copies (operator 1; five words, 0.8). Texts without words are copies of one another."""
    return simhash.drop_similar(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("packing", packing_stage),
]

#: No stage but the third can be said in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
