"""Alignment of two tokenizers' tokens of the same texts, and what the corpus links.

A and B are the tokens of a blank and the text: A by a byte-level vocabulary, B by a piece
model, which adds that blank itself. Both spell the same bytes, so a byte where tokens of
both end cuts the text in two. Alignment divides there: of an interval of tokens, the end
in A nearest the middle that bisection finds among the ends in B splits it, and both halves
go on; an interval that has none is a group. All intervals of many texts are halved in step, as arrays.

The links of a group are its pairs of tokens whose bytes overlap. How many documents hold a
pair is counted over the corpus. Texts stay where they are read: each slice of them
keeps the links of its documents as a sparse table and names its distinct pairs once;
their counts are joined to the pairs of the slices, and come back slice by slice.

Defined cases: texts that are null, empty, or not spelled by their tokens have no tokens
and an empty ``groups_sha256``; rows that repeat are documents each, and count as such; an
empty table gives an empty result; further columns are ignored. Long texts are tokenized in
parts cut at blanks between words and aligned whole, at some 200 bytes of memory a
token; a run without blanks goes to the libraries in one piece.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogforge.llm.bpe import _byte_letters, vocabulary_path
from catalogforge.llm.common import slices, texts
from catalogforge.llm.pieces import Pieces, after_text, byte_level, spread
from catalogforge.session import stage

PIECE_MODEL = "piece_bpe_32k.model"
# Bytes of text that are aligned together and share one table of pairs.
SLICE = 3 << 20
# A pair is one number: its A id times this, and its B id.
SPAN = 1 << 31


class Tokens:
    """What the tokens of a vocabulary spell, and the ids of texts."""

    def __init__(self, spelled: list[bytes], encode, split):
        self.buffer = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.starts = np.cumsum(self.lengths) - self.lengths
        blank = np.array([s.startswith(b" ") for s in spelled], bool)
        self.pieces = Pieces(encode, split, blank, lead=True, check=self._spells)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return spread(self.buffer, self.starts[ids], self.lengths[ids])

    def _spells(self, wanted: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the ids of each piece spell it."""
        expected = [w.encode() for w in wanted]
        if self.bytes_of(ids).tobytes() == b"".join(expected):
            places = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            return np.diff(places[ends]) == np.fromiter(map(len, expected), np.int64, len(expected))
        ends = np.cumsum(sizes)
        parts = zip(expected, ends - sizes, ends, strict=True)
        return np.array([self.bytes_of(ids[a:b]).tobytes() == w for w, a, b in parts], bool)


def byte_tokens(source: str) -> Tokens:
    """Tokens of a byte-level vocabulary file, its special ones left as plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(source)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = True
    letters, vocab = _byte_letters(), json.loads(source)["model"]["vocab"]
    spelled = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(c in letters for c in token):
            spelled[i] = bytes(letters[c] for c in token)

    def encode(pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)]

    return Tokens(spelled, encode, byte_level)


def piece_tokens(model: bytes) -> Tokens:
    """Tokens of a piece model, which puts a blank before what it is given."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=model)
    blank = library.piece_to_id("▁")
    spelled = []
    for i in range(library.vocab_size()):
        piece = library.id_to_piece(i)
        own = bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode()
        spelled.append(b"" if library.is_control(i) or library.is_unknown(i) else own)

    def encode(pieces: list[str]) -> list[list[int]]:
        # The blank alone, of a text that ends in one, is no text to the library.
        found = library.encode([p[1:] for p in pieces], num_threads=1)
        return [x if p != " " else [blank] for p, x in zip(pieces, found, strict=True)]

    return Tokens(spelled, encode, after_text)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which tokens of A end where a token of B does, found by divide and conquer.

    ``first`` and ``last`` (exclusive) are the intervals of A to begin with, whose outer ends
    are shared. Of each open interval the shared end nearest its middle divides it. The search
    goes outward in rings that double, so an interval without any costs its own length.
    """
    cut = np.zeros(len(ends_a), bool)
    cut[last[last > first] - 1] = True
    low, high = first, last - 1
    while True:
        # Inner ends are those of the tokens low to high - 1.
        alive = high > low
        low, high = low[alive], high[alive]
        if not len(low):
            return cut
        middle = (low + high - 1) // 2
        found = np.where(_shared(ends_a[middle], ends_b), middle, -1)
        left, near, far = np.flatnonzero((found < 0) & (high - low > 1)), 1, 1
        while len(left):
            parts, owners = [], []
            for side_low, side_high in ((near, far), (-far, -near)):
                a = np.maximum(middle[left] + side_low, low[left])
                b = np.minimum(middle[left] + side_high, high[left] - 1)
                sizes = np.maximum(b - a + 1, 0)
                ends = np.cumsum(sizes)
                total = int(ends[-1])
                parts.append(np.arange(total) + np.repeat(a - (ends - sizes), sizes))
                owners.append(np.repeat(left, sizes))
            at, owner = np.concatenate(parts), np.concatenate(owners)
            hit = _shared(ends_a[at], ends_b)
            at, owner = at[hit], owner[hit]
            order = np.lexsort((at, np.abs(at - middle[owner]), owner))
            at, owner = at[order], owner[order]
            nearest = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
            found[owner[nearest]] = at[nearest]
            near, far = far + 1, 2 * far + 1
            rest = left[found[left] < 0]
            left = rest[(middle[rest] - near >= low[rest]) | (middle[rest] + near < high[rest])]
        split = found >= 0
        cut[found[split]] = True
        # Halves stay in order, so that bisection walks through the ends.
        low, high = (
            np.column_stack([low[split], found[split] + 1]).ravel(),
            np.column_stack([found[split], high[split]]).ravel(),
        )


def _shared(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``ends`` bisection finds in ``others``, whose last is not exceeded."""
    return others[np.searchsorted(others, ends)] == ends


class Aligned:
    """The tokens of some texts, their groups, and the links within those."""

    def __init__(self, batch: list[str], a: Tokens, b: Tokens):
        whole = [" " + t if t else "" for t in batch]
        self.a_ids, self.n_a = self._ids(a, [t[1:] for t in whole], whole)
        good_a = self.good
        self.b_ids, self.n_b = self._ids(b, [t[1:] for t in whole], whole)
        good = good_a & self.good
        self.a_ids, self.n_a = _kept(self.a_ids, self.n_a, good)
        self.b_ids, self.n_b = _kept(self.b_ids, self.n_b, good)
        self.ends_a = np.cumsum(a.lengths[self.a_ids])
        self.ends_b = np.cumsum(b.lengths[self.b_ids])
        last = np.cumsum(self.n_a)
        some = self.n_a > 0
        cut = shared_cuts(self.ends_a, self.ends_b, (last - self.n_a)[some], last[some])
        # Of each group: the token after its last, in A and in B.
        self.group_a = np.flatnonzero(cut) + 1
        self.group_b = np.searchsorted(self.ends_b, self.ends_a[self.group_a - 1]) + 1
        self.groups_before = np.searchsorted(self.group_a, np.concatenate([[0], last]), side="right")

    def _ids(self, tokens: Tokens, batch: list[str], whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, good = tokens.pieces.encode(batch)
        self.good = good & np.array([bool(t) for t in whole], bool)
        return ids, sizes

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every overlapping pair: its place in A, in B, and its document.

        Two tokens of a group overlap in one stretch between neighbouring ends of either.
        """
        ends = np.sort(np.concatenate([self.ends_a, self.ends_b]), kind="stable")
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
        at_a, at_b = np.searchsorted(self.ends_a, ends), np.searchsorted(self.ends_b, ends)
        return at_a, at_b, np.repeat(np.arange(len(self.n_a)), self.n_a)[at_a]

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text; empty for a document without tokens."""
        sizes_a, sizes_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        group = np.arange(len(self.group_a))
        total = len(self.a_ids) + len(self.b_ids)
        ids, marks = np.zeros(total, np.int64), np.zeros(total, np.int64)
        # A group's tokens of A come first, then those of B.
        place_a = np.arange(len(self.a_ids)) + np.repeat(self.group_b - sizes_b, sizes_a)
        place_b = np.arange(len(self.b_ids)) + np.repeat(self.group_a, sizes_b)
        ids[place_a], ids[place_b] = self.a_ids, self.b_ids
        ends = self.group_a + self.group_b
        marks[ends - sizes_b - 1], marks[ends - 1] = 1, 2
        closing = self.groups_before[1:][self.n_a > 0] - 1
        marks[ends[group[closing]] - 1] = 3
        most = int(ids.max()) + 1 if total else 1
        table = [f"{i}{mark}".encode() for mark in (",", "|", ";", "") for i in range(most)]
        lengths = np.fromiter(map(len, table), np.int64, len(table))
        code = marks * most + ids
        out = spread(np.frombuffer(b"".join(table), np.uint8), (np.cumsum(lengths) - lengths)[code], lengths[code])
        places = np.concatenate([[0], np.cumsum(lengths[code])])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        text = memoryview(out)
        return [
            hashlib.sha256(text[x:y]).hexdigest() if y > x else ""
            for x, y in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)
        ]


def _kept(ids: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids, sizes) if good.all() else (ids[np.repeat(good, sizes)], np.where(good, sizes, 0))


_loaded: dict[str, tuple[Tokens, Tokens]] = {}


def _tokens(source: str, model: bytes) -> tuple[Tokens, Tokens]:
    """Both vocabularies, built once per worker."""
    key = hashlib.md5(source.encode() + model).hexdigest()
    if key not in _loaded:
        _loaded[key] = byte_tokens(source), piece_tokens(model)
    return _loaded[key]


def _sources(docs: DataFrame, a_path: str | None, b_path: str | None):
    with open(a_path or vocabulary_path(), encoding="utf-8") as file:
        source = file.read()
    with open(b_path or vocabulary_path(PIECE_MODEL), "rb") as file:
        return docs.sparkSession.sparkContext.broadcast((source, file.read()))


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_ends, b_ends``: the tokens, and where each group ends in them."""
    sources = _sources(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokens(*sources.value)
        for batch in slices(batches, "text", SLICE):
            found = Aligned(batch.column(1).to_pylist(), a, b)
            before, n_a, n_b = found.groups_before, np.cumsum(found.n_a), np.cumsum(found.n_b)
            n_groups = np.diff(before)
            ends_a = found.group_a - np.repeat(n_a - found.n_a, n_groups)
            ends_b = found.group_b - np.repeat(n_b - found.n_b, n_groups)
            columns = (
                (found.a_ids, np.concatenate([[0], n_a])),
                (found.b_ids, np.concatenate([[0], n_b])),
                (ends_a, before),
                (ends_b, before),
            )
            lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v.astype(np.int32))) for v, e in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
    return texts(docs).mapInArrow(run, schema)


COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
# A slice: its documents as lists, its links (document, pair, how often) packed, its pairs.
SLICES = (
    "slice long, docs array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, "
    "digests array<string>, n_pairs array<int>, links binary, pairs array<long>, holders array<int>"
)


def _sparse(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, documents that hold each; by document: links, pairs; of these: pair, times."""
    at_a, at_b, doc = found.links()
    pair = found.a_ids[at_a].astype(np.int64) * SPAN + found.b_ids[at_b]
    pairs, which = np.unique(pair, return_inverse=True)
    held, times = np.unique(doc * max(len(pairs), 1) + which, return_counts=True)
    owner, which = np.divmod(held, max(len(pairs), 1))
    n = len(found.n_a)
    holders = np.bincount(which, minlength=len(pairs))
    return pairs, holders, np.bincount(doc, minlength=n), np.bincount(owner, minlength=n), which, times


def sliced(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``SLICES``: the documents of ``docs`` aligned, a slice a row."""
    sources = _sources(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokens(*sources.value)
        base = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=1)
        for number, batch in enumerate(slices(batches, "text", SLICE)):
            found = Aligned(batch.column(1).to_pylist(), a, b)
            pairs, holders, n_links, n_pairs, which, times = _sparse(found)
            links = which.astype("<u4").tobytes() + times.astype("<u4").tobytes()
            lists = (found.n_a, found.n_b, np.diff(found.groups_before), n_links)
            columns = [
                pa.array([base + number]),
                _one(batch.column(0), pa.int64()),
                *[_one(v, pa.int32()) for v in lists],
                _one(found.digests(), pa.string()),
                _one(n_pairs, pa.int32()),
                pa.array([packer.compress(links)], pa.binary()),
                _one(pairs, pa.int64()),
                _one(holders, pa.int32()),
            ]
            names = [f.split()[0] for f in SLICES.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).mapInArrow(run, SLICES)


def _one(values, kind: pa.DataType) -> pa.Array:
    """An array of one list."""
    inner = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner.cast(kind))


def link_counts(slices_: DataFrame) -> DataFrame:
    """``pair, n, best``: how many documents hold each pair, and if that is the most of its A id."""
    named = slices_.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    counts = stage(
        named.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("n")), "alignment-counts"
    )
    keyed = counts.withColumn("a", F.expr(f"pair div {SPAN}"))
    most = keyed.groupBy("a").agg(F.max("n").alias("most"))
    return keyed.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summary(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Of every row ``COUNTS``, ``n_best, count_sum`` over its links, and ``groups_sha256``."""
    aligned = stage(sliced(docs, a_path, b_path), "alignment-slices")
    counts = stage(link_counts(aligned), "alignment-links")
    asked = aligned.select("slice", F.posexplode("pairs").alias("place", "pair"))
    # A slice holds a pair once, so none has more rows here than there are slices.
    answered = asked.join(counts, "pair").select("slice", "place", "n", "best")
    kept = aligned.drop("pairs", "holders")
    names = ["docs", "n_a", "n_b", "n_groups", "n_links"]

    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        row = held.to_pylist()[0]
        n_pairs = np.array(row["n_pairs"], np.int64)
        links = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["links"]), "<u4").astype(np.int64)
        which, times = links[: len(links) // 2], links[len(links) // 2 :]
        place = answers.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place] = answers.column("n").to_numpy()
        best[place] = answers.column("best").to_numpy()
        ends = np.concatenate([[0], np.cumsum(n_pairs)])

        def by_document(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[ends[1:]] - total[ends[:-1]]

        columns = [pa.array(row[name], pa.int64()) for name in names]
        columns += [pa.array(by_document(v[which] * times)) for v in (best, n)]
        columns.append(pa.array(row["digests"], pa.string()))
        return pa.table(columns, ["doc_id", *names[1:], "n_best", "count_sum", "groups_sha256"])

    pairs = kept.groupBy("slice").cogroup(answered.toDF(*answered.columns).groupBy("slice"))
    return pairs.applyInArrow(run, f"{COUNTS}, n_best long, count_sum long, groups_sha256 string")
