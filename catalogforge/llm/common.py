"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge.session import stage

# A key counts as hot from one in so many rows on, so at most so many keys are hot.
HOT_SHARE = 1000
# Links that a task contracts at a time.
LINKS = 1 << 18


# Rows of an Arrow batch, where the session does not say otherwise than Spark's default.
ROWS_KEY, ROWS_DEFAULT, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024"


def short_batches(df: DataFrame) -> None:
    """Lets the session send rows with texts to Python in batches of ``ROWS``.

    A batch lies in memory three times, twice outside the heap, before it can be sliced.
    """
    if df.sparkSession.conf.get(ROWS_KEY) == ROWS_DEFAULT:
        df.sparkSession.conf.set(ROWS_KEY, ROWS)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty), whatever else ``docs`` holds."""
    short_batches(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``table`` (unique ``key``) that splits hot keys.

    ``table.count`` says how many rows hold the key. Keys held by more than one in
    ``HOT_SHARE`` of ``total`` rows are at most ``HOT_SHARE`` many; they are
    broadcast, and their rows never move. All other rows meet in a shuffle join.
    ``count`` is not part of the result.
    """
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    extra = [c for c in table.columns if c not in (key, count)]
    few = table.filter(hot).select(
        F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in extra]
    )
    met = rows.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left")
    cold = (
        met.filter(F.col("_hot").isNull())
        .select(*rows.columns)
        .join(table.filter(~hot).drop(count), key, "left")
    )
    warm = met.filter(F.col("_hot").isNotNull()).select(
        *rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in extra]
    )
    return warm.unionByName(cold.select(*rows.columns, *extra))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` (text, bytes or lists of 32-bit numbers) holds about
    ``limit`` bytes in each, one row at least."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start, size = 0, 0
        for i, n in enumerate(byte_lengths(values)):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def byte_lengths(values: pa.Array) -> list[int]:
    if pa.types.is_list(values.type):
        return [4 * (n or 0) for n in pc.list_value_length(values).to_pylist()]
    return [n or 0 for n in pc.binary_length(values).to_pylist()]


class Forest:
    """Union-find over sorted distinct values."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.up = np.arange(len(self.values))

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(nxt := up[up], up):
            up = nxt
        self.up = up
        return up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.searchsorted(self.values, a), np.searchsorted(self.values, b)
        while True:
            up = self.roots()
            x, y = up[a], up[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))

    def tied(self) -> tuple[np.ndarray, np.ndarray]:
        """The values that are tied to a smaller one, and the smallest of each one's tree."""
        up = self.roots()
        tied = up != np.arange(len(up))
        return self.values[tied], self.values[up[tied]]


def _contracted(edges: DataFrame) -> DataFrame:
    """``u, v, part``: for every ``LINKS`` links of a task a forest that ties the same nodes."""

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, part = [], 0, TaskContext.get().partitionId() << 32

        def forest() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy() for b in kept]) for i in (0, 1))
            ties = Forest(np.concatenate([u, v]))
            ties.join(u, v)
            u, v = ties.tied()
            arrays = [pa.array(u), pa.array(v), pa.array(np.full(len(u), part))]
            return pa.RecordBatch.from_arrays(arrays, ["u", "v", "part"])

        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= LINKS:
                yield forest()
                kept, rows, part = [], 0, part + 1
        if rows:
            yield forest()

    return edges.mapInArrow(forests, "u long, v long, part long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (``a``, ``b``) reaches.

    Links are first contracted to forests where they lie; a single forest is the result.
    Forests meet in alternating large and small stars, so the number of rounds grows with the
    logarithm of the longest path. Every round is written to the shared folder. Nodes
    that occur in no edge to another node have no row.
    """
    distinct = (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
    )
    forests = stage(_contracted(distinct), label)
    now = forests.select("u", "v")
    *seen, first, last = _mark(forests, F.min("part"), F.max("part"))
    if first == last:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = tuple(seen)
    while True:
        total = 2 * seen[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_star(both, F.col("v") > F.col("u"), total), label)
        small = _star(large.filter(F.col("u") > F.col("v")), F.lit(True), total, own=True)
        now = stage(small, label)
        mark = _mark(now)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def _mark(edges: DataFrame, *further: Column) -> tuple:
    both = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(both), F.min("u"), *further).first())


def _star(edges: DataFrame, wanted: Column, total: int, own: bool = False) -> DataFrame:
    """Links each wanted neighbour of u (and u itself) to the least of u and its neighbours."""
    least = edges.groupBy("u").agg(
        F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")
    )
    moved = hot_join(edges.filter(wanted), least, "u", "n", total).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    if own:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()
