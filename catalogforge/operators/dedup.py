"""Exact duplicates: keep the first of each, list the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _content(df: DataFrame, content: Sequence[str]) -> list[Column]:
    """A missing value and an empty one are the same content."""
    kinds = dict(df.dtypes)
    return [
        F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`")
        for c in content
    ]


def dedup_first(df: DataFrame, content: Sequence[str], order: str) -> DataFrame:
    """``content`` columns once each, with the smallest ``order`` and the ``copies``.

    ``order`` is a unique integer. Copies collapse inside every task before anything
    is shuffled, so a content held by a third of the rows costs one row per task.
    """
    return (
        df.select(*_content(df, content), F.col(order))
        .groupBy(*[f"`{c}`" for c in content])
        .agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))
    )


def duplicates(df: DataFrame, content: Sequence[str], order: str) -> DataFrame:
    """Every row of ``df`` that ``dedup_first`` does not keep.

    The rows are matched on their unique ``order``, never gathered by content.
    """
    kept = dedup_first(df, content, order).select(order)
    return df.join(kept, order, "left_anti")
