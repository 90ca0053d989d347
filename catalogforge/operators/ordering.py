"""Positions and running numbers without a single-partition window.

Three tools, by kind of order:

* ``dense_sequence``   numbers rows by a unique integer key (lazy, one shuffle);
* ``global_positions`` numbers rows by any sort key (range-partitioned sort, staged);
* ``group_positions``  numbers rows inside groups of any size, by any sort key.

None of them brings a whole table, or a whole group, into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogforge.session import stage

# Keys per window partition in dense_sequence, and keys per block of its totals.
RUN_BITS = 14
BLOCK_BITS = 16

# monotonically_increasing_id keeps the partition above this bit.
PARTITION_SHIFT = 33


def _totals_before(counts: DataFrame, key: str, levels: int = 2) -> DataFrame:
    """``key, before``: the sum of ``n`` over all smaller keys.

    Summed within blocks of neighbouring keys first, then over the block totals, so
    that only the totals of the top level meet in one task.
    """
    block, inside = f"_block{levels}", f"_inside{levels}"
    before = F.sum("n").over(
        Window.partitionBy(block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    of_key = F.shiftright(key, BLOCK_BITS) if levels else F.lit(0).cast("bigint")
    blocked = counts.withColumn(block, of_key)
    sums = blocked.withColumn(inside, F.coalesce(before, F.lit(0)))
    if not levels:
        return sums.select(key, F.col(inside).alias("before"))
    totals = blocked.groupBy(block).agg(F.sum("n").alias("n"))
    outer = _totals_before(totals, block, levels - 1)
    return sums.join(outer, block).select(key, (F.col("before") + F.col(inside)).alias("before"))


def dense_sequence(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """Add ``name``: the rank of the unique integer ``order``, counted from ``start``.

    Rows are cut into runs of neighbouring keys; each run is counted, the counts are
    summed up run by run, and rows are numbered inside their run. Only the run counts
    are ever summed across the table.
    """
    keyed = df.withColumn("_run", F.shiftright(F.col(order).cast("bigint"), RUN_BITS))
    counts = keyed.groupBy("_run").agg(F.count(F.lit(1)).alias("n"))
    offsets = _totals_before(counts, "_run")
    within = F.row_number().over(Window.partitionBy("_run").orderBy(order))
    return (
        keyed.withColumn("_within", within)
        .join(offsets, "_run")
        .withColumn(name, F.col("before") + F.col("_within") + (start - 1))
        .drop("_run", "_within", "before")
    )


def global_positions(
    df: DataFrame, order: Sequence[Column | str], name: str = "position"
) -> DataFrame:
    """Add ``name``: the 1-based place of each row in ``order``, which must be total.

    The rows are range-partitioned and sorted once and written with their partition
    and row number. Offsets are one row per written partition, so summing them in one
    task and broadcasting them is bounded by the number of partitions.
    """
    row = F.monotonically_increasing_id()
    sorted_rows = stage(df.orderBy(*order).withColumn("_row", row), "sorted")
    parted = sorted_rows.withColumn("_part", F.shiftright("_row", PARTITION_SHIFT))
    sizes = parted.groupBy("_part").agg(
        F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1
    offsets = sizes.select("_part", shift.alias("_shift"))
    return (
        parted.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_shift")
    )


def group_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    name: str = "position",
) -> DataFrame:
    """Add ``name``: the 1-based place of each row inside its ``group``.

    A group may be larger than any one task: rows are sorted by group and order
    together and written, so a hot group spans partitions. Each (group, partition) gets
    its offset from the sizes of the earlier ones, and rows meet it on that pair, of
    which none holds more than one partition, with or without adaptive execution.
    """
    row = F.monotonically_increasing_id()
    sorted_rows = stage(df.orderBy(*group, *order).withColumn("_row", row), "sorted")
    parted = sorted_rows.withColumn("_part", F.shiftright("_row", PARTITION_SHIFT))
    sizes = parted.groupBy(*group, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *[F.col(g).alias(f"_{g}") for g in group],
        F.col("_part").alias("_of_part"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return parted.join(offsets, reduce(and_, same, F.col("_part") == F.col("_of_part"))).select(
        *df.columns, (F.col("_row") + F.col("_shift")).alias(name)
    )


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, name: str = "position"
) -> DataFrame:
    """The first ``k`` rows of each group. Spark keeps ``k`` per group in every task
    before it shuffles, so a hot group sends ``k`` rows from each."""
    return df.withColumn(
        name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ).filter(F.col(name) <= k)
