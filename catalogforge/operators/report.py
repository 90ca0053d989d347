"""Validation report of a compile run, and its gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from catalogforge.sources.schema import INLINE_HEADER, NO_HEADER, SEPARATE_HEADER


def report_files(sources: DataFrame) -> DataFrame:
    """``source_path, filename, format, field_count, n_rows``, one row per file."""
    return sources.select(
        "source_path", F.col("source_file").alias("filename"), "format", "field_count", "n_rows"
    )


def with_unread_files(files: DataFrame, discovered: DataFrame) -> DataFrame:
    """Add the files that gave no line at all: they count as one empty field."""
    silent = discovered.join(files, "source_path", "left_anti").select(
        "source_path",
        F.col("source_file").alias("filename"),
        F.lit(NO_HEADER).alias("format"),
        F.lit(1).alias("field_count"),
        F.lit(0).cast("bigint").alias("n_rows"),
    )
    return files.unionByName(silent)


def format_census(files: DataFrame) -> DataFrame:
    """``header_plus_data, separate_header, no_header``: files of each format."""
    return files.agg(
        *[
            F.count_if(F.col("format") == kind).alias(name)
            for kind, name in (
                (INLINE_HEADER, "header_plus_data"),
                (SEPARATE_HEADER, "separate_header"),
                (NO_HEADER, "no_header"),
            )
        ]
    )


def run_statistics(files: DataFrame, deduped: DataFrame) -> DataFrame:
    """One row: files, empty files, rows parsed, duplicates removed, unique rows.

    ``deduped`` is the result of ``dedup_first``, whose ``copies`` add up to all rows.
    """
    of_rows = deduped.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
    )
    empty = files.agg(F.count_if(F.col("n_rows") == 0))
    return of_rows.select(
        files.agg(F.count(F.lit(1))).scalar().alias("files_processed"),
        empty.scalar().alias("empty_files"),
        "total_rows",
        (F.col("total_rows") - F.col("unique_rows")).alias("duplicates_removed"),
        "unique_rows",
    )


def counted(deduped: DataFrame) -> tuple[DataFrame, Observation]:
    """``deduped`` with counts that the job which writes it takes along.

    Write the frame as it is: an action that reads a part counts that part, and a stage before
    one more shuffle counts again if it runs again. Counts wait for the write, and ``reconcile``
    holds them to the files.
    """
    counts = Observation()
    total = F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows")
    return deduped.observe(counts, total, F.count(F.lit(1)).alias("unique_rows")), counts


def counted_statistics(files: DataFrame, counts: Observation) -> DataFrame:
    """``run_statistics`` of rows that were ``counted`` and written; these are not read again."""
    total, unique = (F.lit(counts.get[name]).cast("bigint") for name in ("total_rows", "unique_rows"))
    return files.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.count_if(F.col("n_rows") == 0).alias("empty_files"),
        total.alias("total_rows"),
        (total - unique).alias("duplicates_removed"),
        unique.alias("unique_rows"),
    )


def require_counted(counts: Observation) -> None:
    """``require_rows`` of rows that were ``counted`` and written."""
    if not counts.get["unique_rows"]:
        raise ValueError("no rows were compiled; see the report of files")


def unreadable_files(files: DataFrame, discovered_sizes: DataFrame) -> DataFrame:
    """Files that hold bytes but gave no line; only possible when errors are skipped."""
    return discovered_sizes.filter(F.col("length") > 0).join(files, "source_path", "left_anti")


def require_rows(deduped: DataFrame) -> DataFrame:
    """Fail if nothing was compiled."""
    if deduped.isEmpty():
        raise ValueError("no rows were compiled; see the report of files")
    return deduped


def reconcile(files: DataFrame, stats: DataFrame) -> DataFrame:
    """``expected_rows, total_rows, balanced``: do the file counts match the rows?"""
    expected = files.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).scalar()
    parts = F.col("unique_rows") + F.col("duplicates_removed")
    return stats.withColumn("expected_rows", expected).select(
        "expected_rows",
        "total_rows",
        "unique_rows",
        "duplicates_removed",
        ((F.col("expected_rows") == F.col("total_rows")) & (F.col("total_rows") == parts)).alias(
            "balanced"
        ),
    )


def require_balance(balance: DataFrame) -> None:
    """Fail if rows were lost or gained between the files and the table."""
    found = balance.first()
    if not found.balanced:
        raise ValueError(f"row counts do not add up: {found.asDict()}")
