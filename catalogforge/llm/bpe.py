"""Byte-level BPE: an exact backtracking encoder and a decoder over an offset table.

The encoder never replays merges. An Aho-Corasick automaton finds every vocabulary
entry in a word; from each position the longest is tried first, and it stands if its
border to the token before it is one that merging would leave alone. Otherwise the next
shorter one is tried, or the token before is given up; a position given up once is
never tried again, so the work is linear in the number of matches.

Texts are cut before blanks that precede a non-blank. No pre-token crosses such a cut,
so the pieces encode alone, and a bounded cache of pieces serves most of a text.

Defined cases: null texts count as empty and have no ids; rows that repeat get a row
each; words of any length are encoded whole; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogforge.llm.common import slices, texts

VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the pre-token pattern of the byte-level scheme.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Words and pieces remembered by a worker, and bytes of text taken at a time.
WORDS, PIECES = 450_000, 200_000
LONGEST = 64
SLICE = 4 << 20
# More than the number of tokens.
SPAN = 1 << 31

BLANK_RUN = re.compile(r" (?:\s|\Z)")
BORDER = re.compile(r" (?=\S)")


def pieces(text: str) -> list[str]:
    """The text cut at blanks before a non-blank; all but the first lack their blank."""
    return BORDER.split(text) if BLANK_RUN.search(text) else text.split(" ")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Built from the text of a vocabulary file; tokens are numbered in merge order inside."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        spelled = {t: bytes(letters[c] for c in t) for t in vocab}
        names = sorted((t for t in vocab if len(t) == 1), key=letters.get)
        order = {t: i for i, t in enumerate(names)}
        self.base = len(names)
        self.left, self.right = list(range(self.base)), list(range(self.base))
        # Keyed by left * SPAN + right.
        self.pairs: dict[int, int] = {}
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = order.setdefault(a + b, len(order))
            if made == len(self.left):
                self.left.append(order[a])
                self.right.append(order[b])
                names.append(a + b)
            self.pairs.setdefault(order[a] * SPAN + order[b], made)
        self.ids = [vocab[t] for t in names]
        self.lengths = [len(spelled[t]) for t in names]
        self.automaton = ahocorasick.Automaton()
        for number, name in enumerate(names):
            self.automaton.add_word(spelled[name].decode("latin-1"), number)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        stops = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.stop = regex.compile("|".join(stops)) if stops else None
        self.words = regex.compile(PATTERN)
        by_id = {vocab[t]: s for t, s in spelled.items()}
        by_id |= {i: t.encode() for t, i in self.special.items()}
        self.size = max(by_id) + 1
        parts = [by_id.get(i, b"") for i in range(self.size)]
        # Decoding: all spellings in one buffer, and where each begins.
        self.buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self._agree: dict[int, bool] = {}
        self._words = Cache(lambda w: array("I", self.encode_bytes(w.encode())).tobytes(), WORDS)
        self._starts = Cache(self._piece, PIECES)
        self._later = Cache(lambda p: self._piece(" " + p), PIECES)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between ``a`` and ``b`` alone.

        The token made later is undone, step by step; no pair met at the border may
        have merged before the token last undone was made.
        """
        key, before = a * SPAN + b, len(self.left)
        if (known := self._agree.get(key)) is not None:
            return known
        good = True
        while True:
            if self.pairs.get(a * SPAN + b, before) < before:
                good = False
                break
            if max(a, b) < self.base:
                break
            if a > b:
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]
        if len(self._agree) > WORDS:
            self._agree.clear()
        self._agree[key] = good
        return good

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        n, lengths = len(word), self.lengths
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for end, token in self.automaton.iter(word.decode("latin-1")):
            starting[end + 1 - lengths[token]].append(token)
        given_up = bytearray(n + 1)
        taken: list[int] = []
        tried: list[int] = []
        at, k = 0, len(starting[0]) - 1
        while at < n:
            while k >= 0:
                token = starting[at][k]
                end = at + lengths[token]
                if not given_up[end] and (not taken or self.compatible(taken[-1], token)):
                    break
                k -= 1
            if k >= 0:
                taken.append(token)
                tried.append(k)
                at, k = end, len(starting[end]) - 1
            elif taken:
                given_up[at] = 1
                at -= lengths[taken.pop()]
                k = tried.pop() - 1
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return [self.ids[t] for t in taken]

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self.words.findall(piece)))

    def _plain(self, text: str) -> bytes:
        parts = pieces(text)
        head = self._starts[parts[0]]
        return head + b"".join(map(self._later.__getitem__, parts[1:]))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of special tokens become those tokens."""
        if self.stop is None or not self.stop.search(text):
            return np.frombuffer(self._plain(text), dtype=np.uint32)
        out, at = [], 0
        for found in self.stop.finditer(text):
            out.append(self._plain(text[at : found.start()]))
            out.append(array("I", [self.special[found.group()]]).tobytes())
            at = found.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ``ids``; bytes that are no UTF-8 become replacement characters."""
        starts, sizes = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1]
        sizes = sizes - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
        return self.buffer[at].tobytes().decode("utf-8", "replace")


class Cache(dict):
    """Remembers what ``make`` gave for at most ``limit`` keys, then starts afresh.

    Keys of over ``LONGEST`` letters are not remembered, so it is bounded in bytes too.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


_encoders: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The encoder of a vocabulary file's text, built once per worker."""
    key = hashlib.md5(source.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(source)
    return _encoders[key]


def _source(docs: DataFrame, path: str | None):
    with open(path or vocabulary_path(), encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _encoded(bpe: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
    """``doc_id, ids`` of ``doc_id, text``."""
    found = [bpe.encode(t.as_py()) for t in batch.column(1)]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    values = np.concatenate(found).view(np.int32) if found else np.zeros(0, np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    return pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])


def _decoded(bpe: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
    """``doc_id, ids, text`` of ``doc_id, ids``."""
    ids = batch.column(1)
    ends = ids.offsets.to_numpy()
    values = ids.values.to_numpy(zero_copy_only=False)
    out = [bpe.decode(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.string())], ["doc_id", "ids", "text"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids``: the token ids of every text. ``path``: vocabulary, read by the driver."""
    source = _source(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(source.value)
        for batch in slices(batches, "text", SLICE):
            yield _encoded(bpe, batch)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``text`` for rows of ``doc_id, ids`` (null ids: empty)."""
    source = _source(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(source.value)
        for batch in slices(batches, "ids", SLICE):
            yield _decoded(bpe, batch)

    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), ids)
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``decode(encode(docs))`` with one Python worker a task, where those two in a row take two.

    A worker keeps its encoder for later tasks, so half the workers hold half the memory.
    """
    source = _source(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(source.value)
        for batch in slices(batches, "text", SLICE):
            for part in slices([_encoded(bpe, batch)], "ids", SLICE):
                yield _decoded(bpe, part)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, text string")
