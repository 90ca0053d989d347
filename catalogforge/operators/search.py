"""Keyword search over any text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``term, <key>, hits``: how often each lower-cased word occurs in each text.

    Flat rows, so a word found in every text is no group of its own.
    """
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return (
        df.select(key, F.explode(words).alias("term"))
        .filter(F.col("term") != "")
        .groupBy("term", key)
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def term_frequencies(postings: DataFrame) -> DataFrame:
    """``term, texts, hits``: in how many texts a word occurs, and how often in all."""
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("hits").alias("hits")
    )


def best_matches(found: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The ``top`` texts of a search: most terms matched, then most hits."""
    return found.orderBy(F.desc("matched"), F.desc("hits"), key).limit(top)


def keyword_search(postings: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """``<key>, matched, hits``: texts with any of ``terms``, and how many they match."""
    wanted = sorted({t.lower() for t in terms})
    return (
        postings.filter(F.col("term").isin(wanted))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("matched"), F.sum("hits").alias("hits"))
    )
