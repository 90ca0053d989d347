"""Exports to one compiled table, with its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogforge.operators import dedup, parsing, report
from catalogforge.sources import exports, tables
from catalogforge.sources.schema import COLUMNS, CONTENT, LINEAGE


def compile_exports(
    spark: SparkSession,
    path: str,
    out: str,
    layout: str = "positional",
    csv: bool = False,
    skip_unreadable: bool = False,
    list_duplicates: bool = False,
) -> DataFrame:
    """Read, align and dedup every export below ``path``; write tables below ``out``.

    ``compiled`` holds the unique rows with lineage, ``seq`` and their number of
    ``copies``; ``report_*`` say what was found. With ``csv`` the table is also
    written as CSV under the unified header, and with ``list_duplicates`` the removed
    rows are listed, at the price of one more scan. Fails if there are no rows at
    all, if the rows of the files do not add up, or if exports have names that Spark passes over.
    """
    exports.require_visible(spark, path)
    lines = exports.read_lines(spark, path, skip_unreadable=skip_unreadable)
    run = parsing.parse_lines(lines, layout)
    found = exports.discover_exports(spark, path)

    files = report.with_unread_files(report.report_files(run.sources), found)
    files.write.parquet(f"{out}/report_files")
    files = spark.read.parquet(f"{out}/report_files")
    fields = parsing.unified_header(run.sources)
    fields.write.parquet(f"{out}/report_fields")

    kept, counts = report.counted(run.lineage_of(dedup.dedup_first(run.rows, CONTENT, "seq")))
    kept.write.parquet(f"{out}/compiled")
    report.require_counted(counts)
    compiled = spark.read.parquet(f"{out}/compiled")

    if list_duplicates:
        removed = run.rows.join(compiled.select("seq"), "seq", "left_anti").select(
            F.col("Name").alias("name"), F.col("Artist").alias("artist"), *LINEAGE, "source_path"
        )
        removed.write.parquet(f"{out}/duplicates")

    stats = report.counted_statistics(files, counts)
    report.reconcile(files, stats).write.parquet(f"{out}/report_balance")
    report.require_balance(spark.read.parquet(f"{out}/report_balance"))
    stats.write.parquet(f"{out}/report_stats")
    report.format_census(files).write.parquet(f"{out}/report_formats")
    if skip_unreadable:
        report.unreadable_files(files, exports.file_sizes(spark, path)).write.parquet(
            f"{out}/report_errors"
        )
    if csv:
        write_compiled_csv(compiled, spark.read.parquet(f"{out}/report_fields"), f"{out}/csv")
    return compiled


def write_compiled_csv(compiled: DataFrame, fields: DataFrame, path: str) -> None:
    """The compiled table under its unified header, unknown columns spread out.

    ``source_path`` and the order key ``seq`` come last, so that the table can be read
    back whole by ``tables.compiled_from_csv``.
    """
    unknown = tables.extra_columns(fields, (*COLUMNS, *LINEAGE))
    present = {r.field for r in fields.filter(F.col("field").isin(list(COLUMNS))).collect()}
    order = [c for c in COLUMNS if c in present] + unknown + [*LINEAGE, "source_path", "seq"]
    spread = tables.spread_extra(compiled, unknown)
    tables.write_csv(spread.select(*[F.col(f"`{c}`") for c in order]), path)
