"""Catalogue-shaped views of the driver's tables.

``catalog_src`` is a compiled table made from orders, customers and nations;
``export_lines`` writes its rows out as the lines of export files. ``oracles.py``
states both again in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogforge.sources.schema import COLUMNS, COLUMNS_BY_WIDTH, EXTRA, EXTRA_TYPE

# Order keys per file, so that no source outgrows a task.
KEYS_PER_FILE = 1_000_000
# Orders per task that makes lines of them.
ROWS_PER_TASK = 100_000
MAX_YEAR = 2024

HEADER_18 = COLUMNS_BY_WIDTH[19]
HEADER_9 = ("Name", "Artist", "Album", "Genre", "Size", "Time", "Year", "Mood", "Location")

# Layout of a nation's files, by nation key modulo 8.
LAYOUTS = ("separate", "none", "inline", "short", "unknown", "none", "inline", "short")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int) -> Column:
    return F.col("o_orderkey") % n == 0


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and nation, as the tables hold them."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def catalog_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 26 columns as text, ``seq``, and the nation a row comes from."""
    return _catalog(_orders(spark, sf_dir)).select(
        *[F.col(f"`{c}`") for c in COLUMNS],
        F.array().cast(EXTRA_TYPE).alias(EXTRA),
        F.col("o_orderkey").alias("seq"),
        F.col("n_name").alias("nation"),
        F.col("n_nationkey").alias("nation_key"),
    )


def _catalog(rows: DataFrame) -> DataFrame:
    """``rows`` of ``_orders`` with the 26 columns as text beside their own."""
    key, empty = F.col("o_orderkey"), F.lit("")
    text = key.cast("string")
    day = F.col("o_orderdate").cast("date").cast("string")
    album = F.concat_ws(" ", "c_mktsegment", "o_orderpriority")
    quote = F.lit('"')

    def digit(n: int, start: int = 0) -> Column:
        return (key % n + start).cast("string")

    values = {
        "Name": F.when(_every(97), empty).otherwise(F.concat(F.lit("Order "), text)),
        "Artist": F.when(_every(53), "??")
        .when(_every(59), empty)
        .when(_every(5), F.concat(quote, "n_name", F.lit(', The"')))
        .otherwise(F.col("n_name")),
        "Composer": F.when(_every(19), "  ").otherwise(F.col("c_name")),
        "Album": F.when(_every(61), empty)
        .when(_every(7), F.concat(quote, album, quote))
        .otherwise(album),
        "Grouping": F.when(_every(2), F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).otherwise(
            empty
        ),
        "Genre": F.when(_every(11), "123").otherwise(F.col("o_orderpriority")),
        "Size": F.concat(
            F.floor("o_totalprice").cast("string"), F.when(_every(3), ".75").otherwise(empty)
        ),
        "Time": digit(600),
        "Disc Number": digit(3),
        "Disc Count": F.when(_every(43), "n/a").otherwise("2"),
        "Track Number": digit(20),
        "Track Count": F.lit("20"),
        "Year": F.when(_every(13), "44100")
        .when(_every(17), empty)
        .otherwise(F.year("o_orderdate").cast("string")),
        "Date Modified": day,
        "Date": empty,
        "Date Added": day,
        "Bit Rate": F.element_at(F.array(*map(F.lit, ("0", "128", "192"))), (key % 3 + 1).cast("int")),
        "Sample Rate": F.lit("44100"),
        "Volume Adjustment": digit(7, -3),
        "Kind": F.lit("MPEG audio file"),
        "Equalizer": empty,
        "Comments": F.concat(F.lit("for "), "c_name"),
        "Play Count": empty,
        "Last Played": empty,
        "My Rating": digit(4),
        "Location": F.concat("c_mktsegment", F.lit(":"), text),
    }
    return rows.select("*", *[values[c].alias(c) for c in COLUMNS])


def _tabbed(names: tuple[str, ...], mood: Column) -> Column:
    return F.concat_ws("\t", *[mood if n == "Mood" else F.col(f"`{n}`") for n in names])


def export_lines(spark: SparkSession, sf_dir: str, layout: str = "mixed") -> DataFrame:
    """``source_path, line_no, line``: ``catalog_src`` as lines of files.

    Each nation is a folder with a file per million keys. Every 23rd line is cut
    short, every 31st has surplus fields, every 29th is followed by a blank one, and
    every 41st row occurs again in a folder of copies.
    """
    mixed = F.element_at(F.array(*map(F.lit, LAYOUTS)), (F.col("n_nationkey") % 8 + 1).cast("int"))
    src = _orders(spark, sf_dir).withColumns(
        {
            "seq": F.col("o_orderkey"),
            "layout": mixed if layout == "mixed" else F.lit(layout),
            "bucket": F.floor(F.col("o_orderkey") / KEYS_PER_FILE).cast("string"),
            "folder": F.col("n_name"),
        }
    )
    copies = src.filter(F.col("seq") % 41 == 0).withColumns(
        {"folder": F.lit("COPIES"), "layout": F.lit("none")}
    )
    rows = src.unionByName(copies).withColumn(
        "source_path", F.concat(F.lit("lib/"), "folder", F.lit("/"), "bucket", F.lit(".txt"))
    )
    # Rows are numbered as they are in the tables, and become lines, which are far wider, after
    # that; so many tasks that each sorts and expands about as many rows, whatever their number.
    tasks = max(
        spark.sparkContext.defaultParallelism,
        -(-table(spark, sf_dir, "orders").count() // ROWS_PER_TASK),
    )
    within = (
        Window.partitionBy("source_path")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    place = F.row_number().over(Window.partitionBy("source_path").orderBy("seq"))
    blank = F.when(F.col("seq") % 29 == 0, 1).otherwise(0)
    numbered = rows.repartition(tasks, "source_path").withColumns(
        {"at": place, "first_seq": F.min("seq").over(within), "blanks": F.sum(blank).over(within)}
    )
    # Lines before a row: those of the file's first row, one for each row between, and blank ones.
    headed = F.when(F.col("layout").isin("separate", "unknown"), 1).otherwise(0)
    first_blank = F.when(F.col("first_seq") % 29 == 0, 1).otherwise(0)
    before = F.col("at") - 1 + headed + F.col("blanks") - blank - first_blank
    numbered = numbered.withColumn("before", F.when(F.col("at") == 1, 0).otherwise(before))

    volume = F.lit("\t7")
    mood = F.concat(F.lit("mood "), F.col("`My Rating`"))
    body = (
        F.when(F.col("layout").isin("separate", "short"), F.concat(_tabbed(HEADER_18, mood), volume))
        .when(F.col("layout") == "unknown", _tabbed(HEADER_9, mood))
        .otherwise(F.concat(_tabbed(COLUMNS, mood), volume))
    )
    ragged = (
        F.when(F.col("at") == 1, F.col("body"))
        .when(F.col("seq") % 23 == 0, F.substring_index("body", "\t", 3))
        .when(F.col("seq") % 31 == 0, F.concat("body", F.lit("\tmore\tand more")))
        .otherwise(F.col("body"))
    )
    bodies = _catalog(numbered).withColumn("body", body).withColumn("body", ragged)
    header_18, header_26 = ("\t".join(h) for h in (HEADER_18, COLUMNS))
    first = (
        F.when(F.col("layout") == "separate", F.array(F.lit(header_18 + "\t7"), F.col("body")))
        .when(F.col("layout") == "unknown", F.array(F.lit("\t".join(HEADER_9)), F.col("body")))
        .when(F.col("layout") == "inline", F.array(F.concat(F.lit(header_26 + "\t"), "body")))
        .otherwise(F.array("body"))
    )
    later = F.when(F.col("seq") % 29 == 0, F.array(F.col("body"), F.lit("  "))).otherwise(
        F.array("body")
    )
    lines = bodies.select(
        "source_path",
        "before",
        F.posexplode(F.when(F.col("at") == 1, first).otherwise(later)).alias("part", "line"),
    )
    line_no = (F.col("before") + F.col("part") + 1).cast("bigint")
    return lines.select("source_path", line_no.alias("line_no"), "line")
