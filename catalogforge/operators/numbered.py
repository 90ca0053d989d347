"""Rows under a running number that new rows are added to, in any place of the order.

Rows lie in blocks, each a range of the order. A directory holds where a block begins, how many
rows it has, and how many come before it; a page reads the blocks that its numbers fall into, and
an added run sorts its own rows only. Blocks that grow past twice ``block_rows`` are cut
into new ones, and their rows written once more with the run that filled them, so no task
ever numbers more than that.

Numbers equal those of a full sort by the order, with repeated keys in the order of their
runs. Nulls come first. All runs have the same columns, whatever their names. A run
without rows changes nothing; without any run there are no pages and no numbers (``None``). A
run counts from its commit on; of two added at once, one fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogforge.operators.incremental import Commits
from catalogforge.operators.ordering import (
    PARTITION_SHIFT,
    _totals_before,
    global_positions,
    group_positions,
)
from catalogforge.session import stage

BLOCK_ROWS = 100_000
# Bytes of a row group: a page reads those that its blocks lie in.
ROW_GROUP = 8 << 20
# Numbers of a run's new blocks lie above this bit, after those of earlier runs.
RUN_SHIFT = 32


def _placed(new: DataFrame, blocks: DataFrame) -> DataFrame:
    """``key, row, block``: the block whose range each row falls into.

    Rows and the starts of blocks are sorted together; a row takes the last start before it, in its own
    partition of the sort or else an earlier one. Rows before every start take the first block.
    """
    starts = blocks.select(
        F.col("low").alias("key"), F.lit(None).cast(new.schema["row"].dataType).alias("row"), "block"
    )
    both = new.withColumn("block", F.lit(None).cast("long")).unionByName(starts)
    row = F.monotonically_increasing_id()
    parted = stage(both.orderBy("key").withColumn("_row", row), "numbered-sorted").withColumn(
        "_part", F.shiftright("_row", PARTITION_SHIFT)
    )
    # One row for each partition of the sort.
    ends = parted.groupBy("_part").agg(F.max_by("block", F.when(F.col("block").isNotNull(), F.col("_row"))).alias("end"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("end", ignorenulls=True).over(earlier).alias("_carried"))
    within = Window.partitionBy("_part").orderBy("_row")
    found = parted.withColumn("_last", F.last("block", ignorenulls=True).over(within))
    first = blocks.agg(F.min_by("block", "ordinal")).scalar()
    return (
        found.filter(F.col("row").isNotNull())
        .join(F.broadcast(carried), "_part")
        .select("key", "row", F.coalesce("_last", "_carried", first).alias("block"))
    )


def _directory(blocks: DataFrame) -> DataFrame:
    """``ordinal, block, low, n, before``: the blocks in order and the rows before each."""
    placed = stage(global_positions(blocks.select("block", "low", "n"), ["low"], "ordinal"), "numbered-blocks")
    return placed.join(_totals_before(placed.select("ordinal", "n"), "ordinal"), "ordinal")


class Numbered(Commits):
    """The numbered rows below a folder, by ``order`` (ascending columns)."""

    def __init__(self, spark: SparkSession, out: str, order: Sequence[Column | str], block_rows: int = BLOCK_ROWS):
        super().__init__(spark, out)
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        self.block_rows = block_rows

    def add(self, rows: DataFrame) -> int:
        """Adds ``rows`` and returns the number of the run."""
        run = self.next_run()
        keys = [c.alias(f"k{i}") for i, c in enumerate(self.order)]
        # The last two tell repeated keys apart; staged, as the second depends on the layout.
        keys += [F.lit(run).alias("run"), F.monotonically_increasing_id().alias("at")]
        new = stage(rows.select(F.struct(*keys).alias("key"), F.struct("*").alias("row")), "numbered-new")
        blocks, stored = self.blocks(), self.table("rows")
        if blocks is None or stored is None:
            placed = new.withColumn("block", F.lit(0).cast("long"))
            none = F.lit(None).cast(new.schema["key"].dataType).alias("low")
            blocks = self.spark.range(1).select(F.col("id").alias("block"), none, F.lit(0).cast("long").alias("n"))
            stored = placed.limit(0)
        else:
            placed = stage(_placed(new, blocks), "numbered-placed")

        added = placed.groupBy("block").agg(F.count("*").alias("_added"))
        n = F.col("n") + F.coalesce("_added", F.lit(0))
        sizes = stage(blocks.join(added, "block", "left").select("block", "low", n.alias("n")), "numbered-sizes")
        full = sizes.filter(F.col("n") > 2 * self.block_rows).select("block")
        kept = placed.join(full, "block", "left_anti").select("block", "key", "row")
        left = sizes.join(full, "block", "left_anti")

        span = full.agg(F.min("block"), F.max("block")).first()
        if span is not None and span[0] is not None:
            moved, cut = self._cut(run, placed, stored.filter(F.col("block").between(*span)), full)
            kept, left = kept.unionByName(moved), left.unionByName(cut)
        base = f"{self.out}/run={run}"
        # What a run of this number left before it failed is named by nothing.
        kept.orderBy("block", "key").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{base}/rows")
        _directory(left).write.mode("overwrite").parquet(f"{base}/blocks")
        self._commit(run)
        return run

    def _cut(self, run: int, placed: DataFrame, stored: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of ``full`` blocks in blocks of ``block_rows``, and those blocks."""
        rows = placed.select("block", "key", "row").unionByName(stored.select("block", "key", "row"))
        ranked = group_positions(rows.join(full, "block", "left_semi"), ["block"], ["key"])
        at = F.floor((F.col("position") - 1) / self.block_rows)
        ranked = ranked.select(F.col("block").alias("_of"), at.alias("_at"), "key", "row")
        parts = ranked.groupBy("_of", "_at").agg(F.min("key").alias("low"), F.count("*").alias("n"))
        number = F.col("_number") + F.lit((run + 1) << RUN_SHIFT)
        parts = stage(global_positions(parts, ["_of", "_at"], "_number"), "numbered-parts").withColumn("block", number)
        moved = ranked.join(parts.select("_of", "_at", "block"), ["_of", "_at"]).select("block", "key", "row")
        return moved, parts.select("block", "low", "n")

    def blocks(self) -> DataFrame | None:
        """``ordinal, block, low, n, before`` of the blocks in use; rows of others are cut ones'."""
        done = self.committed()
        return self.spark.read.parquet(f"{self.out}/run={done[-1]}/blocks") if done else None

    def count(self) -> int:
        blocks = self.blocks()
        return 0 if blocks is None else blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def positions(self, name: str = "position") -> DataFrame | None:
        """All rows with their 1-based number, in place of a column of that name."""
        blocks, rows = self.blocks(), self.table("rows")
        if blocks is None or rows is None:
            return None
        return self._number(rows.join(blocks.select("block", "before"), "block"), name)

    def page(self, page: int, size: int, name: str = "position") -> DataFrame | None:
        """The rows numbered ``(page - 1) * size + 1`` to ``page * size``.

        At most ``size`` blocks hold them, whose numbers become a filter of the scan.
        """
        blocks, rows = self.blocks(), self.table("rows")
        if blocks is None or rows is None:
            return None
        start, end = (page - 1) * size, page * size
        held = blocks.filter((F.col("before") < end) & (F.col("before") + F.col("n") > start)).select("block", "before")
        few = rows.filter(F.col("block").isin([r.block for r in held.collect()]))
        numbers = self._number(few.join(F.broadcast(held), "block"), name)
        return numbers.filter((F.col(name) > start) & (F.col(name) <= end))

    def _number(self, rows: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("block").orderBy("key")) + F.col("before")
        names = [c for c in rows.schema["row"].dataType.fieldNames() if c != name]
        return rows.select(*[F.col("row").getField(c).alias(c) for c in names], place.alias(name))
