"""Token ids as Parquet list columns, laid out for selective reads.

Texts are dealt to shards by ranges of ``doc_id``, so shards follow one another in
order and none holds the whole table. The ids of a document are one list; its shard,
its place in the shard and its length stand beside it, so a reader of lengths or places
never touches an id. Ids are dictionary-coded (a vocabulary is small), places and
lengths delta-coded (Parquet's second writer version). Row groups and pages have set
sizes, and pages carry column indexes, so a range of documents reads its own pages only.

Defined cases: null texts count as empty and hold the end id alone; a null ``doc_id``
comes first; rows with equal ids come in the order of their texts; an empty table
writes no rows; further columns are ignored. Long texts are encoded in parts cut at blanks
between words; the ids of one document are one list, so it may have 2**31 of them at most.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogforge.llm.bpe import vocabulary_path
from catalogforge.llm.common import slices, texts
from catalogforge.llm.pieces import Pieces, byte_level

END_ID = 0
SCHEMA = "doc_id long, shard int, place long, n_tokens int, ids array<int>"

# Fixed by the writer: dictionary for ids, delta for the rest, sizes of groups and pages.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#place": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}

SLICE = 4 << 20
# Bytes that the table of pieces may hold: what it forgets goes to the library once more.
MEMORY = 160 << 20

_tokenizers: dict[str, Tokenizing] = {}


class Tokenizing:
    """The tokenizers library behind a bounded table of the pieces between blanks.

    A byte-level pre-token encodes alone, and none crosses a blank before a non-blank. A
    text with the string of an added token goes to the library whole.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.stops = [t.content for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size()
        # The letter that byte-level vocabularies write for a blank.
        blank = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.pieces = Pieces(self.encoded, byte_level, blank, lead=False, memory=MEMORY)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has."""
        stopped = [any(s in t for s in self.stops) for t in batch]
        values, sizes, _ = self.pieces.encode("" if s else t for s, t in zip(stopped, batch, strict=True))
        if not any(stopped):
            return values, sizes
        ends = np.cumsum(sizes)
        found = [
            np.array(self.encoded([t])[0], np.int32) if s else values[b - n : b]
            for s, t, n, b in zip(stopped, batch, sizes, ends, strict=True)
        ]
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))


def _tokenizing(source: str) -> Tokenizing:
    if source not in _tokenizers:
        _tokenizers[source] = Tokenizing(source)
    return _tokenizers[source]


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Rows of ``SCHEMA``, in shards that follow one another in ``doc_id`` order."""
    spark = docs.sparkSession
    with open(path or vocabulary_path(), encoding="utf-8") as file:
        source = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, place = _tokenizing(source.value), 0
        shard = TaskContext.get().partitionId()
        for batch in slices(batches, "text", SLICE):
            found, lengths = library.encode(batch.column(1).to_pylist())
            values = np.insert(found, np.cumsum(lengths), end_id)
            sizes = (lengths + 1).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            arrays = [
                batch.column(0),
                pa.array(np.full(len(sizes), shard, np.int32)),
                pa.array(place + ends[:-1].astype(np.int64)),
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
            ]
            place += int(ends[-1])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "shard", "place", "n_tokens", "ids"])

    rows = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the token files of ``docs`` to the folder ``out``."""
    tokenized(docs, path, end_id).write.options(**LAYOUT).parquet(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """``SCHEMA`` and ``start``: the ids of all documents before each one.

    The base of a shard is the sum of the shards before it: one row per shard, summed
    from the lengths alone.
    """
    from pyspark.sql import Window

    rows = spark.read.schema(SCHEMA).parquet(out)
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row per shard, so its size is the number of tasks that wrote.
    met = rows.join(F.broadcast(bases), "shard")
    return met.select(*rows.columns, (F.col("base") + F.col("place")).alias("start"))


def checksums(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
            found = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            sizes = pa.array(np.diff(ends).astype(np.int64))
            arrays = [batch.column(0), batch.column(1), sizes, pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
