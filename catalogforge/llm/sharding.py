"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

Texts that are equal form a group, which one shard takes whole. Differencing keeps partial
partitions, each a row of shard sums; the two of the largest spread are combined in
opposite order, largest sum onto smallest, until one is left.

A heap of all groups fits no machine, so the groups shrink in rounds. Groups are dealt to
blocks by hash and each block is differenced on its own, into bundles of near equal bytes
that go on as items. Two sorts of items go on as they are, whatever the size of the table:
heavy ones, which a bundle would hide, and a share of the lightest by hash, which level
what is left at the end. The last round differences a bounded number of items of every
scale into the shards. Nothing is dropped, and a table that fits the last round is
differenced exactly.

Defined cases: null texts count as empty, and both as one group; rows that repeat are all
placed; a null ``doc_id`` comes first within its shard; a text of any length is one item;
an empty table gives an empty result; further columns are ignored. A group that outweighs
a fair shard has one to itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogforge.llm.common import hot_join
from catalogforge.operators.ordering import group_positions
from catalogforge.session import stage

SHARDS = 24
# Bytes that each row adds to those of its text.
ROW_BYTES = 8
# Items that one differencing takes: in the last round, and in a block of an earlier one.
LAST, BLOCK = 1 << 15, 1 << 13
# Bundles that a block gives, and light items that stay single, in each round.
BUNDLES, LIGHT = 24, 1 << 12
# An item of one in so many bytes of the table is heavy, so at most so many are.
HEAVY = SHARDS * 128


def difference(sizes: Sequence[int], count: int) -> np.ndarray:
    """The part (0 to ``count`` - 1) of each size; parts are numbered from the heaviest down.

    A bin is an item or the join of two bins, so combining two partial partitions costs
    ``count`` steps whatever they hold.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int32)
    joined: list[tuple[int, int]] = []
    blank = [(0, -1)] * (count - 1)
    order = sorted(range(n), key=lambda i: (-sizes[i], i))
    heap = [(-sizes[i], at, [(sizes[i], i), *blank]) for at, i in enumerate(order)]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, first = heapq.heappop(heap)
        _, _, second = heapq.heappop(heap)
        bins = []
        for (a, x), (b, y) in zip(first, reversed(second), strict=True):
            if x >= 0 and y >= 0:
                joined.append((x, y))
                x = n + len(joined) - 1
            bins.append((a + b, max(x, y)))
        bins.sort(reverse=True)
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], made, bins))
        made += 1
    part = np.zeros(n + len(joined), np.int32)
    for number, (_, node) in enumerate(heap[0][2]):
        if node >= 0:
            part[node] = number
    for at in range(len(joined) - 1, -1, -1):
        x, y = joined[at]
        part[x] = part[y] = part[n + at]
    return part[:n]


def _differenced(items: DataFrame, count: int) -> DataFrame:
    """``item, part``: each block (``block, item, bytes``) cut into ``count`` parts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending")])
        part = difference(table.column("bytes").to_pylist(), count)
        return table.select(["block", "item"]).append_column("part", pa.array(part))

    return items.groupBy("block").applyInArrow(run, "block long, item binary, part int")


def _rounds(items: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """At most ``LAST`` items, and for each round before, the ``item, bundle`` it made."""
    links: list[DataFrame] = []
    while True:
        n, total = items.agg(F.count("*"), F.sum("bytes")).first()
        if n <= LAST:
            return items, links
        spread = F.pmod(F.xxhash64("item", F.lit(len(links))), F.lit(n))
        heavy = F.col("bytes") * HEAVY > F.lit(total)
        marked = items.withColumn("alone", heavy | (spread < LIGHT))
        blocks = -(-n // BLOCK)
        dealt = marked.filter(~F.col("alone")).select(
            F.pmod(F.xxhash64(F.lit(-1 - len(links)), "item"), F.lit(blocks)).alias("block"), "item", "bytes"
        )
        name = F.sha2(F.concat_ws(":", F.lit(len(links)), "block", "part"), 256)
        made = _differenced(dealt, BUNDLES).select("item", F.unhex(name).alias("bundle"))
        links.append(stage(made, "sharding-bundles"))
        sums = links[-1].join(items, "item").groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
        single = marked.filter("alone").select("item", "bytes")
        items = stage(single.unionByName(sums.withColumnRenamed("bundle", "item")), "sharding-items")


def placed(items: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``item, shard`` of ``item`` (unique, binary) and ``bytes``."""
    last, links = _rounds(items)
    whole = last.select(F.lit(0).cast("long").alias("block"), "item", "bytes")
    found = stage(_differenced(whole, shards).select("item", F.col("part").alias("shard")), "sharding-last")
    for made in reversed(links):
        of_bundle = found.withColumnRenamed("item", "bundle")
        within = made.join(of_bundle, "bundle").select("item", "shard")
        singles = found.join(made.select(F.col("bundle").alias("item")), "item", "left_anti")
        found = stage(singles.unionByName(within), "sharding-found")
    return found


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, item, shard, slot`` of every row; slots follow ``doc_id``.

    ``item`` is the SHA-256 of the text. Only digests and sizes are shuffled, never texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("item"),
        ),
        "sharding-rows",
    )
    groups = stage(rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "sharding-groups")
    shard_of = groups.select("item", "n").join(placed(groups.select("item", "bytes"), shards), "item")
    met = hot_join(rows, shard_of, "item", "n", rows.count())
    numbered = group_positions(met, ["shard"], ["doc_id", "item"], "slot")
    return numbered.withColumn("slot", F.col("slot") - 1)


def write(docs: DataFrame, out: str, shards: int = SHARDS, files: int = 1) -> None:
    """Writes whole rows below ``out``, a folder a shard, each in slot order and in ``files`` files.

    ``doc_id`` must be unique here; raise ``files`` with the bytes of a shard.
    """
    places = assign(docs, shards).select(F.col("doc_id").alias("_id"), "shard", "slot")
    met = docs.withColumnRenamed("shard", "_shard").withColumnRenamed("slot", "_slot") if {"shard", "slot"} & set(docs.columns) else docs
    rows = met.join(places, met["doc_id"].eqNullSafe(places["_id"])).drop("_id")
    spread = rows.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    spread.write.partitionBy("shard").parquet(out)
