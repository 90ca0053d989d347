"""Tables in and out: CSV for interchange, JSON documents, Parquet by default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogforge import functions as C
from catalogforge.sources.schema import CHUNK_SCHEMA, COLUMNS, EXTRA, EXTRA_TYPE, LINEAGE


def extra_columns(unified: DataFrame, known: tuple[str, ...]) -> list[str]:
    """Names in a unified header beyond ``known``, all of them: columns must be named up front."""
    names = unified.filter(~F.col("field").isin(list(known))).orderBy("ordinal")
    return [r.field for r in names.select("field").collect()]


def spread_extra(df: DataFrame, names: list[str]) -> DataFrame:
    """Turn ``extra`` into one column per name, empty where a row has no value."""

    def value(name: str):
        pairs = F.filter(EXTRA, lambda e: e["name"] == name)
        return F.coalesce(F.get(pairs, F.lit(0))["value"], F.lit("")).alias(name)

    return df.select("*", *[value(n) for n in names]).drop(EXTRA)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, doubled quotes, values exactly as they are, empty for missing."""
    df.na.fill("").write.csv(
        path,
        header=True,
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Everything as text, empty where missing.

    ``multi_line`` reads values with line ends in them, at the price of one task per
    file; compiled rows never hold any.
    """
    table = spark.read.csv(
        path, header=True, inferSchema=False, escape='"', multiLine=multi_line
    )
    return table.na.fill("")


def compiled_from_csv(spark: SparkSession, path: str, order: str = "seq") -> DataFrame:
    """A compiled table read from CSV, fit for the build and the extractors.

    Known columns that the file lacks are empty, columns that no list knows go to
    ``extra`` where filled, and ``order`` holds the order of the rows.
    """
    table = read_csv(spark, path)
    if order not in table.columns:
        raise ValueError(f"the file has no column {order!r} to say the order of its rows")
    kept = {*COLUMNS, *LINEAGE, order, "source_path"}
    others = [c for c in table.columns if c not in kept]
    pairs = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in others]
    extra = F.filter(F.array(*pairs).cast(EXTRA_TYPE), lambda e: e["value"] != "")
    known = [F.col(f"`{c}`") if c in table.columns else F.lit("").alias(c) for c in COLUMNS]
    rest = [F.col(f"`{c}`") for c in (*LINEAGE, "source_path") if c in table.columns]
    return table.select(*known, extra.alias(EXTRA), *rest, F.col(order).cast("bigint").alias(order))


def write_chunks(documents: DataFrame, path: str, folder_per_chunk: bool = False) -> None:
    """Chunk documents as JSON, each with its ``name`` (``tracks-001``).

    Many documents share a file by default. ``folder_per_chunk`` puts each in a folder
    ``name=tracks-001``, which suits a small site and not a billion chunks.
    """
    name = F.concat(F.lit("tracks-"), C.padded("chunk", 3))
    writer = documents.withColumn("name", name).write.option("ignoreNullFields", False)
    (writer.partitionBy("name") if folder_per_chunk else writer).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk documents under a fixed schema, however many there are."""
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One document per row, nulls written out."""
    df.write.option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
