"""Keyword extraction: frequent content words of a person's or source's texts (our own definition)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, query_terms


def top_keywords(texts: DataFrame, owner: str, text: str, limit: int = 20) -> DataFrame:
    """owner, keywords: the terms of most of the owner's texts, most frequent first, then alphabetical."""
    terms = texts.select(owner, F.explode(query_terms(text)).alias("term")).where(~F.col("term").isin(*STOP_WORDS) & (F.length("term") > 2))
    counts = terms.groupBy(owner, "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy(owner).orderBy(F.col("n").desc(), "term")
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return best.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
