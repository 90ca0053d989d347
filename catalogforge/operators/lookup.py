"""Tables laid out by slug, so that a page of one artist or album reads only its rows.

Two layouts. ``write_clustered`` sorts rows by slug into small row groups with Bloom filters
and page indexes: a lookup asks the footers and reads the groups that may hold the slug.
``write_bucketed`` deals an index and its tracks to the same buckets, so that joining the
two moves no track again. The rows of a slug that holds a large part of the table are dealt
by a second key (``salt``), and its index row is copied for each; other slugs have one salt.

Null slugs are kept in the clustered table and found by no lookup; a bucketed join
leaves them out, as any join does. Slugs without rows, and empty tables, give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogforge.session import stage

BUCKETS = 64
# A slug is split where it holds more rows than a fair bucket.
SALT = "salt"


def layout(key: str) -> dict[str, str]:
    """Writer options of a table clustered by ``key``."""
    return {
        "parquet.block.size": str(4 << 20),
        "parquet.page.size": str(64 << 10),
        "parquet.page.row.count.limit": "1000",
        f"parquet.bloom.filter.enabled#{key}": "true",
        f"parquet.enable.dictionary#{key}": "false",
        "parquet.enable.dictionary": "true",
    }


def write_clustered(df: DataFrame, out: str, key: str, order: str, files: int | None = None) -> None:
    """Writes ``df`` sorted by ``key`` and ``order``; a hot key spreads over several files."""
    counts = (files,) if files else ()
    rows = df.repartitionByRange(*counts, key, order).sortWithinPartitions(key, order)
    rows.write.options(**layout(key)).parquet(out)


def look_up(spark: SparkSession, path: str, key: str, slug: str) -> DataFrame:
    """The rows of one slug; the comparison reaches the footers, filters and page indexes."""
    return spark.read.parquet(path).filter(F.col(key) == slug)


def _salts(tracks: DataFrame, key: str, buckets: int) -> DataFrame:
    """``slug, salts`` of the slugs that hold more rows than a fair bucket; so fewer than ``buckets``."""
    counts = stage(tracks.groupBy(F.col(key).alias("slug")).agg(F.count(F.lit(1)).alias("n")), "slug-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("n") * buckets / F.lit(max(total, 1))).cast("int")
    return counts.select("slug", parts.alias("salts")).filter("salts > 1 AND slug IS NOT NULL")


def write_bucketed(
    index: DataFrame, tracks: DataFrame, key: str, order: str, name: str, buckets: int = BUCKETS
) -> None:
    """Saves tables ``<name>_index`` and ``<name>_tracks``, bucketed alike by slug and salt.

    ``index.slug`` is unique; ``tracks.<key>`` refers to it and ``tracks.<order>`` tells rows apart.
    """
    hot = stage(_salts(tracks, key, buckets), "slug-salts")
    # Fewer slugs than buckets are hot, by their very definition.
    of_track = tracks.join(F.broadcast(hot.withColumnRenamed("slug", key)), key, "left")
    salted = of_track.withColumn(
        SALT, F.pmod(F.xxhash64(order), F.coalesce("salts", F.lit(1))).cast("int")
    ).select(*tracks.columns, SALT)
    of_index = index.join(F.broadcast(hot), "slug", "left")
    copies = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    copied = of_index.select(*index.columns, F.explode(copies).alias(SALT))
    for rows, own, part in ((salted, key, "tracks"), (copied, "slug", "index")):
        dealt = rows.repartition(buckets, own, SALT)
        dealt.write.bucketBy(buckets, own, SALT).sortBy(own, SALT).format("parquet").saveAsTable(f"{name}_{part}")


def bucketed_tracks(spark: SparkSession, key: str, name: str) -> DataFrame:
    """Every index row with its tracks, joined bucket by bucket.

    The merge hint keeps the planner from broadcasting an index that grows with the data.
    """
    index = spark.table(f"{name}_index").alias("i").hint("merge")
    tracks = spark.table(f"{name}_tracks").alias("t")
    same = (F.col("i.slug") == F.col(f"t.{key}")) & (F.col(f"i.{SALT}") == F.col(f"t.{SALT}"))
    mine = [F.col(f"i.{c}") for c in spark.table(f"{name}_index").columns if c != SALT]
    theirs = [F.col(f"t.{c}") for c in spark.table(f"{name}_tracks").columns if c != SALT]
    return index.join(tracks, same).select(*mine, *theirs)
