"""Language identification by unigram pieces, summed over all segmentations.

The pieces of a fixed public vocabulary get a probability in each language. A word's
probability is the sum over all its segmentations into pieces (a forward pass), so no
segmentation has to be chosen; a text's is the product over its words. Probabilities
come from expectation-maximisation over word counts of a bounded, evenly drawn sample of
labelled documents: each round runs over the counts in tasks, and only sums by piece and
language, as many as the vocabulary has at most, reach the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every
text where nothing can be learned; of languages that fit equally the first by name wins; a
null ``doc_id`` hashes as the empty string; rows that repeat get a row each; words of any
length are summed whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge.llm.common import slices
from catalogforge.session import stage

VOCABULARY = "piece_bpe_32k.model"
# Labelled documents learned from, about so many for each language.
SAMPLE = 1500
ROUNDS = 2
# Weight of the pieces' general probability in each language, in expected pieces.
SMOOTHING = 50.0
# Probability of a character that is no piece, alike in every language.
UNKNOWN = 1e-8
# Characters (with the word mark) that a batched forward pass takes.
SHORT = 28
LONGEST = 16
WORDS = 800_000
SLICE = 4 << 20
UND = "und"

_LETTER = regex.compile(r"\p{L}")
# ASCII punctuation parts words and is no evidence.
_PARTS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO_BLANK = bytes(32 if chr(c) in _PARTS else c for c in range(256))


def split_words(text: str) -> list[str]:
    return text.lower().encode().translate(_TO_BLANK).decode().split()


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces, without control and byte pieces. Read by the driver only."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    ids = range(model.get_piece_size())
    special = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
    return [model.id_to_piece(i) for i in ids if not any(f(i) for f in special)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


class Lattice:
    """Piece numbers of every substring; the last two stand for unknown and impossible."""

    def __init__(self, pieces: list[str]):
        # Beginnings of longer pieces are known too, so that a search can stop early.
        self.number = {p[:i]: -1 for p in pieces for i in range(2, len(p))}
        self.number |= {p: i for i, p in enumerate(pieces)}
        self.unknown, self.never = len(pieces), len(pieces) + 1

    def edges(self, words: list[str]) -> np.ndarray:
        """(word, start, length - 1) for words of one length."""
        n, get = len(words[0]), self.number.get
        width = min(n, LONGEST)
        out = np.full(len(words) * n * width, self.never, np.int32)
        at, found, row = [], [], 0
        for w in words:
            for i in range(n):
                at.append(row)
                found.append(get(w[i], self.unknown))
                for j in range(i + 2, min(n, i + width) + 1):
                    piece = get(w[i:j])
                    if piece is None:
                        break
                    if piece >= 0:
                        at.append(row + j - i - 1)
                        found.append(piece)
                row += width
        out[at] = found
        return out.reshape(len(words), n, width)

    def by_length(self, words: list[str], most: int = 4096) -> Iterator[tuple[list[int], np.ndarray]]:
        """Places of the words of each length with their edges, in blocks."""
        groups: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            groups.setdefault(len(word), []).append(at)
        for places in groups.values():
            for i in range(0, len(places), most):
                part = places[i : i + most]
                yield part, self.edges([words[j] for j in part])


def forward(edges: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """Sums over all segmentations of each prefix; ``table``: (piece, ...) probabilities."""
    n, width = edges.shape[1:]
    sums = [np.ones((edges.shape[0], *table.shape[1:]))]
    for j in range(1, n + 1):
        total = 0.0
        for i in range(max(0, j - width), j):
            total = total + sums[i] * table[edges[:, i, j - i - 1]]
        sums.append(total)
    return sums


class Scorer:
    """Log-probabilities of words in each language, with a bounded memory of words."""

    def __init__(self, pieces: list[str], table: np.ndarray):
        self.lattice, self.table = Lattice(pieces), table
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.blocks = np.zeros((1024, self.table.shape[1]))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > WORDS:
            self.forget()
            new = list(words)
        start = len(self.place)
        while start + len(new) > len(self.blocks):
            self.blocks = np.concatenate([self.blocks, np.zeros_like(self.blocks)])
        marked = ["▁" + w for w in new]
        short = [i for i, w in enumerate(marked) if len(w) <= SHORT]
        for places, edges in self.lattice.by_length([marked[i] for i in short]):
            at = [start + short[i] for i in places]
            self.blocks[at] = np.log(forward(edges, self.table)[-1])
        for i, word in enumerate(marked):
            if len(word) > SHORT:
                self.blocks[start + i] = self.long(word)
        self.place |= {w: start + i for i, w in enumerate(new)}

    def long(self, word: str) -> np.ndarray:
        """The same sum for a word of any length, rescaled as it goes."""
        get, lattice, table = self.lattice.number.get, self.lattice, self.table
        sums, scale = [np.ones(table.shape[1])], np.zeros(table.shape[1])
        for j in range(1, len(word) + 1):
            total = sums[-1] * table[get(word[j - 1], lattice.unknown)]
            for length in range(2, min(len(sums), LONGEST) + 1):
                piece = get(word[j - length : j])
                if piece is not None and piece >= 0:
                    total = total + sums[-length] * table[piece]
            scale += np.log(total)
            sums = [s / total for s in sums[1 - LONGEST :]] + [np.ones_like(total)]
        return scale

    def score(self, texts: list[str]) -> np.ndarray:
        """(text, language) log-probabilities."""
        parts = [split_words(t) for t in texts]
        self.learn(set().union(*parts))
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(parts):
            if words:
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                out[i] = self.blocks[at].sum(axis=0)
        return out


def _normalised(counts: np.ndarray) -> np.ndarray:
    """Counts (piece, language) to probabilities, and rows for unknown and impossible."""
    general = (counts.sum(axis=1) + 0.1) / (counts.sum() + 0.1 * len(counts))
    table = (counts + SMOOTHING * general[:, None]) / (counts.sum(axis=0) + SMOOTHING)
    ends = np.array([[UNKNOWN], [0.0]]).repeat(counts.shape[1], axis=1)
    return np.concatenate([table, ends])


def learn(docs: DataFrame, pieces: list[str], sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and the (piece, language) table; ``docs``: ``doc_id, text, lang``."""
    spark = docs.sparkSession
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    langs = [r["lang"] for r in sizes]
    if not langs:
        return [], np.zeros((0, 0))
    shares = spark.createDataFrame(
        [(r["lang"], min(1.0, sample / r["count"])) for r in sizes], "lang string, share double"
    )
    draw = (F.xxhash64("doc_id", "text") / F.lit(2.0**64)) + 0.5
    drawn = rows.join(F.broadcast(shares), "lang").filter(draw < F.col("share"))
    # Longer runs, as of scripts without blanks, are learned from in parts of that length.
    parts = F.regexp_extract_all(F.lower("text"), F.lit(rf"[^\s\p{{Punct}}]{{1,{SHORT - 1}}}"), 0)
    counted = drawn.select("lang", F.explode(parts).alias("word")).groupBy("lang", "word")
    counts = stage(counted.agg(F.count("*").alias("n")).repartition("word"), "langid-words")
    shipped = spark.sparkContext.broadcast(pieces)
    table = None
    for _ in range(ROUNDS + 1):
        table = _normalised(_expected(counts, langs, shipped, table, len(pieces)))
    return langs, table


def _expected(words: DataFrame, langs: list[str], pieces, table, size: int) -> np.ndarray:
    """Expected counts of pieces by language; without a table all segmentations weigh by length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(pieces.value)
        sums = np.zeros((size + 2, len(langs)))
        for frame in _gathered(frames):
            for at, lang in enumerate(langs):
                part = frame[frame["lang"] == lang]
                weights = part["n"].to_numpy(float)
                for places, edges in lattice.by_length(["▁" + w for w in part["word"]]):
                    _collect(sums[:, at], edges, weights[places], None if table is None else table[:, at])
        piece, at = np.nonzero(sums[:size])
        yield pd.DataFrame({"piece": piece, "at": at, "n": sums[piece, at]})

    found = words.mapInPandas(run, "piece int, at int, n double")
    counts = np.zeros((size, len(langs)))
    for r in found.groupBy("piece", "at").agg(F.sum("n").alias("n")).collect():
        counts[r.piece, r.at] = r.n
    return counts


def _gathered(frames: Iterator[pd.DataFrame], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """The frames joined to ``rows`` or more, as each costs sums over all pieces."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def _collect(sums: np.ndarray, edges: np.ndarray, weights: np.ndarray, p: np.ndarray | None) -> None:
    count, n, width = edges.shape
    if p is None:
        p = np.full(len(sums), 1e-3)
        p[-2:] = UNKNOWN, 0.0
    ahead = forward(edges, p)
    back = [np.zeros(count)] * n + [np.ones(count)]
    for i in range(n - 1, -1, -1):
        total = np.zeros(count)
        for j in range(i + 1, min(n, i + width) + 1):
            piece = edges[:, i, j - i - 1]
            way = p[piece] * back[j]
            total += way
            # Complete only once both sides are known; ``ahead`` is.
            seen = weights * ahead[i] * way / ahead[n]
            sums += np.bincount(piece, seen, len(sums))
        back[i] = total


_scorers: dict[int, Scorer] = {}


def predict(docs: DataFrame, langs: list[str], pieces: list[str], table: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``score`` is the posterior of the language."""
    shipped = docs.sparkSession.sparkContext.broadcast((pieces, table))
    key = shipped._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if langs and key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*shipped.value)
        for batch in slices(batches, "text", SLICE):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            preds, scores = [UND] * len(texts), np.zeros(len(texts))
            if langs:
                logs = _scorers[key].score(texts)
                best = logs.argmax(axis=1)
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                for i, text in enumerate(texts):
                    if _LETTER.search(text):
                        preds[i], scores[i] = langs[best[i]], odds[i, best[i]] / odds[i].sum()
            arrays = [batch.column(0), pa.array(preds, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """Learns from the rows that are not held out, then predicts every row."""
    pieces = vocabulary(path)
    langs, table = learn(docs.filter(~held_out()), pieces, sample)
    found = predict(docs, langs, pieces, table)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
