"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. What is seen of a line (how its characters, words and
repetitions are made up, where it stands, how often the document repeats it) falls into
bins, and a line's evidence is the sum of learned weights for its own bins and for those of
its two neighbours. A chain joins the lines; exact forward-backward marginals, weighted by
line length, average to the document's score.

All counting is numpy over the bytes of many texts at once. The weights are fitted on the
driver from a bounded sample of labelled documents (``SAMPLE``), whose lines all carry the
document's label; scoring covers every line of every text.

Defined cases: null texts count as empty, and an empty text is one empty line and scored
like any; documents that repeat get a row each; a null ``doc_id`` hashes as the empty
string and has no label; null or conflicting labels teach as they stand (null: not at
all); without labels of both kinds every score is the share of good labels (0.5 without
any); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge.llm.common import short_batches, slices, texts
from catalogforge.session import stage

# Labelled documents learned from, at most about; lines of one that are used at a time.
SAMPLE = 6000
# Lines of the sample that the driver fits on; its documents are taken in the order of their draw.
LINES = 400_000
WINDOW = 64
BLOCK = 4096
EPOCHS, RATE, DECAY = 150, 0.05, 1e-4
BINS = 8
SLICE = 1 << 20

# Fixed: characters that count as symbols.
SYMBOLS = b"#$%&*+/<=>@[]^_`{|}~"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    letter = np.array([bytes([c]).isalpha() or c >= 128 for c in code])
    return {
        "upper": (code >= 65) & (code <= 90),
        "digit": (code >= 48) & (code <= 57),
        "letter": letter,
        "space": np.isin(code, [9, 10, 11, 12, 13, 32]),
        "symbol": np.isin(code, list(SYMBOLS)),
        "stop": np.isin(code, list(b".!?")),
        "bang": code == 33,
        "comma": np.isin(code, list(b",;:")),
    }


CLASSES = _classes()


class _Powers:
    """Powers of an odd multiplier and of its inverse, to hash any range from prefix sums."""

    size = 0

    @classmethod
    def up_to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
            with np.errstate(over="ignore"):
                steps = np.full(n, _MULTIPLIER, np.uint64)
                back = np.full(n, inverse, np.uint64)
                steps[0] = back[0] = 1
                cls.up, cls.down = np.cumprod(steps), np.cumprod(back)
            cls.size = n
        return cls.up[:n], cls.down[:n]


def _ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    up, down = _Powers.up_to(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        mixed = (sums[ends] - sums[starts]) * down[starts]
        mixed ^= mixed >> np.uint64(31)
        return mixed * _MULTIPLIER


def _per(key: np.ndarray, flags: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(key[flags], minlength=size).astype(float)


@dataclass
class Lines:
    """Facts of the lines of some texts: ``facts`` is (line, fact), ``first`` where texts begin."""

    facts: np.ndarray
    length: np.ndarray
    first: np.ndarray


FACTS = (
    "words", "word_length", "upper", "digit", "symbol", "stop", "bang", "comma", "short",
    "distinct", "adjacent", "copies", "line_count", "ends", "capital", "most_common", "variety",
)


def lines(texts: list[bytes]) -> Lines:
    """Facts of every line of ``texts``."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.array([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    count = len(ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([first, [count]])))
    length = ends - starts
    line = np.repeat(np.arange(count), length + 1)
    has = {name: table[data] for name, table in CLASSES.items()}
    n = np.maximum(length, 1)
    total = {name: _per(line, flags, count) for name, flags in has.items()}

    blank = has["space"]
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    closes = ~blank & np.concatenate([blank[1:], [True]])
    w_start, w_end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    w_line = line[w_start]
    w_size = w_end - w_start
    w_hash = _ranges(data, w_start, w_end)
    words = np.bincount(w_line, minlength=count).astype(float)
    some = np.maximum(words, 1)
    packed = np.sort((w_line.astype(np.uint64) << np.uint64(40)) | (w_hash >> np.uint64(24)))
    new = np.concatenate([[True], packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, bool)
    kinds = np.bincount((packed[new] >> np.uint64(40)).astype(np.int64), minlength=count)
    runs = np.diff(np.concatenate([np.flatnonzero(new), [len(packed)]]))
    most = np.zeros(count)
    np.maximum.at(most, (packed[new] >> np.uint64(40)).astype(np.int64), runs)
    same = np.zeros(len(w_hash), bool)
    same[1:] = (w_hash[1:] == w_hash[:-1]) & (w_line[1:] == w_line[:-1])
    # The same over the whole text, for texts that repeat themselves across lines.
    w_doc = doc[w_line]
    packed = np.sort((w_doc.astype(np.uint64) << np.uint64(40)) | (w_hash >> np.uint64(24)))
    new = np.concatenate([[True], packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, bool)
    d_kinds = np.bincount((packed[new] >> np.uint64(40)).astype(np.int64), minlength=len(texts))
    d_words = np.bincount(w_doc, minlength=len(texts))

    l_hash = _ranges(data, starts, ends)
    packed = (doc.astype(np.uint64) << np.uint64(40)) | (l_hash >> np.uint64(24))
    _, inverse, copies = np.unique(packed, return_inverse=True, return_counts=True)
    many = np.diff(np.concatenate([first, [count]]))[doc]
    last = np.where(length > 0, data[np.maximum(ends - 1, 0)], 10)
    head = data[starts]
    facts = np.stack(
        [
            np.log1p(words),
            (n - total["space"] + 1) / some,
            total["upper"] / np.maximum(total["letter"], 1),
            total["digit"] / n,
            total["symbol"] / n,
            total["stop"] / some,
            total["bang"] / some,
            total["comma"] / some,
            np.bincount(w_line, w_size <= 3, count) / some,
            kinds / some,
            np.bincount(w_line, same, count) / some,
            np.where(length > 0, np.minimum(copies[inverse], 50), 0),
            np.log1p(many),
            CLASSES["stop"][last].astype(float),
            CLASSES["upper"][head].astype(float),
            most / some,
            (d_kinds / np.maximum(d_words, 1))[doc],
        ],
        axis=1,
    )
    return Lines(facts, length, first)


# --- the model ------------------------------------------------------------------------


@dataclass
class Model:
    """Cuts between bins by fact, weights by (place, fact, bin), bias and chain weights."""

    cuts: np.ndarray
    weights: np.ndarray
    bias: float
    chain: np.ndarray
    constant: float | None = None

    def evidence(self, found: Lines) -> np.ndarray:
        return self.of_bins(_bins(found.facts, self.cuts), found.first)

    def of_bins(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        score = np.full(len(bins), self.bias)
        for place, shifted in enumerate(_around(bins, first)):
            for fact in range(bins.shape[1]):
                score += self.weights[place, fact][shifted[:, fact]]
        return score

    def score(self, texts: list[bytes]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        found = lines(texts)
        odds = self.evidence(found).tolist()
        stops = [*found.first[1:].tolist(), len(odds)]
        out = []
        for a, b in zip(found.first.tolist(), stops, strict=True):
            good = np.array(marginals(odds[a:b], self.chain))
            weight = np.maximum(found.length[a:b], 1)
            out.append(float(min(1.0, max(0.0, (good * weight).sum() / weight.sum()))))
        return out


def _bins(facts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    columns = [np.searchsorted(cuts[i], facts[:, i], side="right") for i in range(facts.shape[1])]
    return np.stack(columns, axis=1).astype(np.int8)


def _around(bins: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """Bins of the line, of the one before and of the one after; beyond a text, an own bin."""
    yield bins
    before = np.concatenate([bins[:1], bins[:-1]])
    before[first] = BINS
    yield before
    after = np.concatenate([bins[1:], bins[-1:]])
    after[np.concatenate([first[1:] - 1, [len(bins) - 1]])] = BINS
    yield after


def _step(x: float, to_good: float, to_bad: float, stay_bad: float, stay_good: float) -> float:
    """Log-odds passed along the chain from a line with log-odds ``x``."""
    a, b = to_good, stay_good + x
    c, d = stay_bad, to_bad + x
    top = max(a, b) + math.log1p(math.exp(-abs(a - b)))
    return top - max(c, d) - math.log1p(math.exp(-abs(c - d)))


def marginals(odds: list[float], chain: np.ndarray) -> list[float]:
    """Probability of good for each line; ``chain[i, j]`` weighs label i before label j."""
    (bb, bg), (gb, gg) = chain.tolist()
    ahead, back = [0.0] * len(odds), [0.0] * len(odds)
    for i in range(1, len(odds)):
        ahead[i] = _step(odds[i - 1] + ahead[i - 1], bg, gb, bb, gg)
    for i in range(len(odds) - 2, -1, -1):
        back[i] = _step(odds[i + 1] + back[i + 1], gb, bg, bb, gg)
    every = (min(max(o + a + b, -700.0), 700.0) for o, a, b in zip(odds, ahead, back, strict=True))
    return [1.0 / (1.0 + math.exp(-x)) for x in every]


def fit(facts: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Model:
    """Weights from the lines of labelled texts, by gradient ascent on the likelihood."""
    share = float(labels.mean()) if len(labels) else 0.5
    shape = (3, len(FACTS), BINS + 1)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros((len(FACTS), 1)), np.zeros(shape), 0.0, np.zeros((2, 2)), share)
    levels = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = np.quantile(facts, levels, axis=0).T
    bins = _bins(facts, cuts)
    stops = np.concatenate([first[1:], [len(bins)]])
    # Long texts become several chains.
    pieces = [
        (a, min(a + WINDOW, stop), y)
        for start, stop, y in zip(first.tolist(), stops.tolist(), labels.tolist(), strict=True)
        for a in range(start, stop, WINDOW)
    ]
    begin = np.array([p[0] for p in pieces])
    size = np.array([p[1] - p[0] for p in pieces])
    target = np.array([p[2] for p in pieces], float)
    steps = np.arange(size.max())
    inside = steps[None, :] < size[:, None]
    at = np.where(inside, begin[:, None] + steps[None, :], 0)
    # Each text counts once, however many lines it has.
    share_of = (1.0 / np.repeat(stops - first, stops - first))[at] * inside
    offsets = (np.arange(3 * len(FACTS)) * (BINS + 1)).reshape(3, -1)
    coded = [b + o for b, o in zip(_around(bins, first), offsets, strict=True)]
    coded = np.concatenate([c.astype(np.int16) for c in coded], axis=1)
    # Evidence and gradient take so many lines at a time: eight bytes for each of a line's bins.
    blocks = [slice(a, a + BLOCK) for a in range(0, len(coded), BLOCK)]
    flat = np.zeros(3 * len(FACTS) * (BINS + 1) + 1)
    chain = np.eye(2)
    moments = [np.zeros((2, len(flat))), np.zeros((2, 4))]
    documents = len(labels)
    for epoch in range(1, EPOCHS + 1):
        evidence = np.concatenate([flat[coded[b]].sum(axis=1) for b in blocks])
        odds = (evidence + flat[-1])[at] * inside
        good, pairs = _expect(odds, inside, chain)
        gap = np.zeros(len(bins))
        np.add.at(gap, at[inside], ((target[:, None] - good) * share_of)[inside])
        grad = np.zeros(len(flat))
        for b in blocks:
            np.add.at(grad, coded[b].ravel(), np.repeat(gap[b], coded.shape[1]))
        grad[-1] = gap.sum()
        grad = grad / documents - DECAY * flat
        y = target.astype(int)
        seen = np.zeros((2, 2))
        weight = share_of[:, 1:]
        np.add.at(seen, (y, y), weight.sum(axis=1))
        joint = (seen - (pairs * weight[:, :, None, None]).sum(axis=(0, 1))) / documents
        joint = joint - DECAY * chain
        flat = flat + _adam(moments[0], grad, epoch)
        chain = chain + _adam(moments[1], joint.ravel(), epoch).reshape(2, 2)
    return Model(cuts, flat[:-1].reshape(shape), float(flat[-1]), chain)


def _adam(moments: np.ndarray, grad: np.ndarray, epoch: int) -> np.ndarray:
    moments[0] = 0.9 * moments[0] + 0.1 * grad
    moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
    return RATE * (moments[0] / (1 - 0.9**epoch)) / (np.sqrt(moments[1] / (1 - 0.99**epoch)) + 1e-8)


def _expect(odds: np.ndarray, inside: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of lines, and of neighbours (chain, line, label, next label), by forward-backward."""
    (bb, bg), (gb, gg) = chain
    ahead, back = np.zeros_like(odds), np.zeros_like(odds)
    last = odds.shape[1] - 1
    for t in range(1, last + 1):
        x = odds[:, t - 1] + ahead[:, t - 1]
        ahead[:, t] = np.logaddexp(bg, gg + x) - np.logaddexp(bb, gb + x)
    for t in range(last - 1, -1, -1):
        x = odds[:, t + 1] + back[:, t + 1]
        step = np.logaddexp(gb, gg + x) - np.logaddexp(bb, bg + x)
        back[:, t] = np.where(inside[:, t + 1], step, 0.0)
    good = 1.0 / (1.0 + np.exp(-np.clip(odds + ahead + back, -700, 700)))
    here, there = (odds + ahead)[:, :-1], (odds + back)[:, 1:]
    joint = np.zeros((*here.shape, 2, 2))
    for i in range(2):
        for j in range(2):
            joint[:, :, i, j] = i * here + j * there + chain[i, j]
    joint = np.exp(joint - joint.max(axis=(2, 3), keepdims=True))
    return good, joint / joint.sum(axis=(2, 3), keepdims=True)


# --- on Spark -------------------------------------------------------------------------


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, budget: int = LINES) -> Model:
    """Fits on about ``sample`` labelled rows that are not held out, drawn by a hash of the id.

    Of those, only documents that fit into ``budget`` lines together reach the driver.
    """
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    ).filter(F.col("quality").isin(0, 1) & ~held_out())
    total = known.count()
    draw = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    # Bounded by ``sample``, so every task may hold it.
    drawn = known.filter(draw < min(1.0, sample / max(total, 1)))
    rows = texts(docs).join(F.broadcast(drawn), "doc_id").select("text", "quality", draw.alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = lines([t.as_py().encode() for t in batch.column(0)])
            stops = [*found.first[1:].tolist(), len(found.facts)]
            facts = [
                found.facts[a:b].astype(np.float32).tobytes()
                for a, b in zip(found.first.tolist(), stops, strict=True)
            ]
            n = np.diff([*found.first.tolist(), len(found.facts)])
            arrays = [pa.array(facts, pa.binary()), batch.column(1), batch.column(2), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["facts", "quality", "draw", "n"])

    drawn_facts = stage(rows.mapInArrow(run, "facts binary, quality int, draw double, n long"), "quality-facts")
    held = drawn_facts.groupBy("draw").agg(F.sum("n").alias("n")).orderBy("draw").collect()
    taken, left = [], budget
    for row in held:
        if row["n"] <= left:
            taken.append(row["draw"])
            left -= row["n"]
    if len(taken) < len(held):
        chosen = docs.sparkSession.createDataFrame([(d,) for d in taken], "draw double")
        drawn_facts = drawn_facts.join(F.broadcast(chosen), "draw", "left_semi")
    found = drawn_facts.select("facts", "quality").collect()
    found.sort(key=lambda r: (bytes(r.facts), r.quality))
    parts = [np.frombuffer(r.facts, np.float32).reshape(-1, len(FACTS)) for r in found]
    facts = np.concatenate(parts).astype(float) if parts else np.zeros((0, len(FACTS)))
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(int)
    return fit(facts, first, np.array([r.quality for r in found]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = model.score([t.as_py().encode() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learned without the held-out third."""
    found = score(docs, learn(docs, labels, sample))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    short_batches(docs)
    model = learn(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            values = ["" if t is None else t for t in batch.column(at).to_pylist()]
            good = np.array(model.score([t.encode() for t in values])) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
