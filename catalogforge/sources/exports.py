"""Finding export files and reading their lines.

A line is ``source_path, source_file, segment, pos, line``. A segment is a bounded
piece of one source (a file split, or a run of lines of a table); ``pos`` grows by
one per line inside it. Nothing here needs a whole file in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogforge.functions import decode_lines

# Names of export files, and of a report written among them.
PATTERNS = ("*.txt", "Library.export*")
EXCLUDED = ("validation_report.txt",)

LINES_PER_SEGMENT = 1 << 16


def _plain(uri: Column) -> Column:
    """File paths reach SQL percent-encoded; a plain ``+`` is not an encoded blank."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.when(F.instr(uri, "%") > 0, decoded).otherwise(uri)


def _pin_splits(spark: SparkSession) -> None:
    """Keep file splits the same in every scan of this session.

    Split size otherwise follows the number of cores alive when a scan is planned,
    and parsing scans the lines twice.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, spark.sparkContext.defaultParallelism)


def _base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _reader(spark: SparkSession, patterns: Sequence[str], skip_unreadable: bool):
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(patterns) + "}")
        .option("ignoreCorruptFiles", skip_unreadable)
        .option("ignoreMissingFiles", skip_unreadable)
    )


def discover_exports(
    spark: SparkSession,
    path: str,
    patterns: Sequence[str] = PATTERNS,
    excluded: Sequence[str] = EXCLUDED,
) -> DataFrame:
    """``source_path, source_file`` of every export below ``path``, empty files too.

    The list is the file index Spark itself keeps on the driver for a scan; table
    scans would leave out files of length zero.
    """
    paths = _reader(spark, patterns, False).text(path).inputFiles()
    found = spark.createDataFrame([(p,) for p in paths], "uri string")
    # Without a host part the index writes ``file:///``, scans write ``file:/``.
    plain = _plain(F.regexp_replace("uri", "^([^:/]+):///", "$1:/"))
    return found.select(plain.alias("source_path"), _base_name(plain).alias("source_file")).filter(
        ~F.col("source_file").isin(list(excluded))
    )


def require_visible(
    spark: SparkSession,
    path: str,
    patterns: Sequence[str] = PATTERNS,
    excluded: Sequence[str] = EXCLUDED,
) -> None:
    """Fail if exports lie in files or folders that Spark passes over.

    Spark never lists names that begin with ``_`` or ``.``. They are looked for level by
    level through the session's file system, by name alone.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def is_export(name: str) -> bool:
        return name not in excluded and any(fnmatchcase(name, p) for p in patterns)

    found, level = [], path.rstrip("/")
    while files.globStatus(hadoop.Path(f"{level}/*")):
        for entry in files.globStatus(hadoop.Path(f"{level}/{{_,.}}*")) or ():
            if entry.isFile():
                names = [entry.getPath()]
            else:
                inside = files.listFiles(entry.getPath(), True)
                names = []
                while inside.hasNext():
                    names.append(inside.next().getPath())
            found += [n.toString() for n in names if is_export(n.getName())]
        level += "/*"
    if found:
        raise ValueError(f"{len(found)} exports have hidden names, rename them: {sorted(found)[:10]}")


def file_sizes(
    spark: SparkSession,
    path: str,
    patterns: Sequence[str] = PATTERNS,
    excluded: Sequence[str] = EXCLUDED,
) -> DataFrame:
    """``source_path, length`` of every export that holds bytes; contents are not read."""
    files = _reader(spark, patterns, True).format("binaryFile").load(path)
    return files.filter(~F.col("_metadata.file_name").isin(list(excluded))).select(
        _plain(F.col("_metadata.file_path")).alias("source_path"), "length"
    )


def read_lines(
    spark: SparkSession,
    path: str,
    patterns: Sequence[str] = PATTERNS,
    excluded: Sequence[str] = EXCLUDED,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Lines of every export below ``path``; any line ending, bad bytes replaced.

    Files are split like any text input, so one huge file still spreads over the
    cluster. A split is a segment: its rows come out in file order in one task, so
    ``monotonically_increasing_id`` counts them.
    """
    _pin_splits(spark)
    meta = "_metadata"
    lines = _reader(spark, patterns, skip_unreadable).text(path)
    if excluded:
        lines = lines.filter(~F.col(f"{meta}.file_name").isin(list(excluded)))
    return lines.select(
        _plain(F.col(f"{meta}.file_path")).alias("source_path"),
        _plain(F.col(f"{meta}.file_name")).alias("source_file"),
        F.col(f"{meta}.file_block_start").alias("segment"),
        F.monotonically_increasing_id().alias("pos"),
        F.make_valid_utf8("value").alias("line"),
    )


def lines_from_table(df: DataFrame, path: str, line_no: str, line: str) -> DataFrame:
    """Lines held in a table: ``line_no`` counts 1, 2, 3, ... within each ``path``."""
    number = F.col(line_no).cast("bigint")
    return df.select(
        F.col(path).alias("source_path"),
        _base_name(F.col(path)).alias("source_file"),
        F.floor((number - 1) / LINES_PER_SEGMENT).alias("segment"),
        number.alias("pos"),
        F.make_valid_utf8(line).alias("line"),
    )


def lines_from_texts(df: DataFrame, path: str, text: str) -> DataFrame:
    """Lines of whole texts held in a table, one text per ``path``."""
    return lines_from_table(
        df.select(
            F.col(path).cast("string").alias("path"),
            F.posexplode(decode_lines(text)).alias("at", "line"),
        ).withColumn("line_no", F.col("at") + 1),
        "path",
        "line_no",
        "line",
    )
