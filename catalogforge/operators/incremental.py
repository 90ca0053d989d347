"""Adding new exports to a compiled table without starting over.

A manifest says which files a run has seen, by path, size, time and digest, so that the next run parses only what is new or changed. Contents met before are known by digest: each bucket
of digests has a Bloom filter, and only rows that may be in it meet the exact index. A run's
tables appear together: they are written beside the others and count from the moment that
one small file names them.

``add_run`` over parts, in the order of ``seq``, equals one run over all: the smallest ``seq``
of a content stays, and its copies add up. Order keys of later parts must be larger. Digests
are 256 bits of the content, with nulls and empty texts as one, so equal digests stand for
equal rows. A run without new rows adds empty tables; an empty table of runs knows nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogforge.operators.dedup import dedup_first
from catalogforge.session import stage

# Buckets of digests; bits of each one's filter, kept as words of 64, and probes of a digest. All
# runs of a folder share these. Beyond some two million contents the filters fill up and
# spare less of the exact join; a larger table takes more buckets from its first run on.
BUCKETS, WORDS, PROBES = 256, 1 << 10, 4
# The table that names the runs that are whole.
COMMITS = "commits"


# --- files that a run has seen --------------------------------------------------------


def manifest(spark: SparkSession, path: str, patterns: Sequence[str]) -> DataFrame:
    """``source_path, length, modified, digest`` of every file; a file is read by one task."""
    rows = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(patterns) + "}")
        .load(path)
    )
    return rows.select(
        F.col("path").alias("source_path"),
        "length",
        F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("digest"),
    )


def differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """``source_path, change``: files that are ``added``, ``changed`` or ``gone``.

    A file of other time but equal digest is the same file.
    """
    old = before.select("source_path", F.col("digest").alias("old"))
    new = now.select("source_path", F.col("digest").alias("new"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "gone")
        .when(F.col("old") != F.col("new"), "changed")
    )
    met = old.join(new, "source_path", "full").select("source_path", change.alias("change"))
    return met.filter("change IS NOT NULL")


# --- contents that runs have kept -----------------------------------------------------


def content_digest(df: DataFrame, content: Sequence[str]) -> Column:
    """SHA-256 of the content columns; a null and an empty text are one, and lengths keep
    neighbouring values apart."""

    def spelled(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        text = column if kind == "string" else F.to_json(F.struct(column.alias("v")))
        text = F.coalesce(text, F.lit(""))
        return F.concat(F.length(text).cast("string"), F.lit(":"), text)

    kinds = dict(df.dtypes)
    return F.unhex(F.sha2(F.concat(*[spelled(c, kinds[c]) for c in content]), 256))


def _bits() -> list[Column]:
    """Places of a digest in the filter of its bucket."""
    return [F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(64 * WORDS)).cast("int") for i in range(PROBES)]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("int").alias("bucket")


def filters(digests: DataFrame) -> DataFrame:
    """``bucket, word, bits``: Bloom filters of ``digest``, a row for each word with a bit in it.

    Words are ORed inside every task first; a bucket has ``WORDS`` of them at most.
    """
    places = digests.select(_bucket(), F.explode(F.array(*_bits())).alias("place"))
    words = places.select("bucket", F.shiftright("place", 6).alias("word"), (F.col("place") % 64).alias("bit"))
    return words.groupBy("bucket", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """One filter of several: their words ORed."""
    return reduce(DataFrame.unionByName, parts).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))


def may_hold(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The ``rows`` (with ``digest``) whose bits are all set in ``known``; none held is missing.

    ``known`` has ``BUCKETS * WORDS`` rows of 16 bytes at most (4 MB), so it is broadcast as
    one array of words a bucket.
    """
    filled = known.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    met = rows.withColumn("bucket", _bucket()).join(F.broadcast(filled), "bucket")

    def is_set(place: Column) -> Column:
        word = F.coalesce(F.element_at("words", F.shiftright(place, 6)), F.lit(0).cast("long"))
        return F.getbit(word, place % 64) == 1

    return met.filter(reduce(lambda a, b: a & b, map(is_set, _bits()))).select(*rows.columns)


# --- runs -----------------------------------------------------------------------------


class Commits:
    """Numbered runs below a folder, each a set of tables that counts from its commit on."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def committed(self) -> list[int]:
        """The runs that are whole, one number each."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{COMMITS}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(path))

    def _commit(self, run: int) -> None:
        """Creating the file fails where another run has the number: one of two wins."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{COMMITS}/{run}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.create(path, False).close()

    def table(self, name: str) -> DataFrame | None:
        paths = [f"{self.out}/run={run}/{name}" for run in self.committed()]
        return self.spark.read.parquet(*paths) if paths else None

    def next_run(self) -> int:
        done = self.committed()
        return done[-1] + 1 if done else 0


class Runs(Commits):
    """The runs below a folder: rows kept, copies found later, digests, filters, manifests."""

    def add_run(self, rows: DataFrame, content: Sequence[str], order: str, seen: DataFrame | None = None) -> int:
        """Dedups ``rows`` among themselves and against all runs, and commits what is new.

        Returns the number of the run. ``seen`` is the manifest to keep with it.
        """
        run = self.next_run()
        own = dedup_first(rows, content, order)
        own = stage(own.withColumn("digest", content_digest(own, content)), "incremental-own")
        known, bloom = self.table("digests"), self.table("filters")
        if known is None or bloom is None:
            fresh, again = own, own.limit(0)
        else:
            asked = own.select("digest")
            maybe = may_hold(asked, merged([bloom]))
            met = stage(maybe.join(known, "digest").select("digest", F.col(order).alias("first")), "incremental-met")
            again = own.join(met, "digest")
            fresh = own.join(met, "digest", "left_anti")
        base = f"{self.out}/run={run}"
        # A run that failed before its commit has left tables that nothing names.
        fresh.drop("digest").write.mode("overwrite").parquet(f"{base}/rows")
        kept = fresh.select("digest", order).repartition(_bucket())
        kept.write.mode("overwrite").parquet(f"{base}/digests")
        filters(fresh.select("digest")).write.mode("overwrite").parquet(f"{base}/filters")
        first = F.col("first") if "first" in again.columns else F.lit(None).cast("long").alias("first")
        again.select(first, "copies").write.mode("overwrite").parquet(f"{base}/copies")
        if seen is not None:
            seen.write.mode("overwrite").parquet(f"{base}/manifest")
        self._commit(run)
        return run

    def compiled(self, order: str) -> DataFrame | None:
        """All rows kept, once each, with their ``copies`` over all runs."""
        rows, copies = self.table("rows"), self.table("copies")
        if rows is None or copies is None:
            return None
        later = copies.groupBy(F.col("first").alias(order)).agg(F.sum("copies").alias("_later"))
        met = rows.join(later, order, "left")
        total = (F.col("copies") + F.coalesce("_later", F.lit(0))).alias("copies")
        return met.select(*[total if c == "copies" else F.col(f"`{c}`") for c in rows.columns])
