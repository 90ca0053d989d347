"""SimHash fingerprints, and exact Hamming links through a vantage-point tree.

Fingerprints are hashed per document in Arrow batches. Distinct fingerprints are then
dealt to the leaves of a vantage-point tree whose upper levels are laid out from a
bounded sample; the sample decides only how evenly leaves fill. A fingerprint lives in
one leaf. Where its distance to a vantage point lies within ``radius`` of the boundary,
a copy of it is sent as a query to the other side, so every pair within ``radius``
meets in exactly one leaf. A leaf searches its own smaller tree, prunes by the same
triangle bounds, and returns a spanning forest of its links, never all pairs.

Defined cases: null texts count as empty; texts without words have fingerprint zero and
link like any other; rows that repeat get a row each; a null ``doc_id`` takes part but
never names a component (a component of such rows alone has a null id); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogforge.llm.common import Forest, components, hot_join, texts
from catalogforge.session import stage

SHINGLE = 3
RADIUS = 2
SEED = 42

# Fingerprints that shape the distributed levels of the tree, at most.
SAMPLE = 16_384
# Fingerprints a leaf should hold, and below which a leaf compares all.
LEAF = 4096
SMALL = 512

_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text; A-Z lower-cased, words split at ASCII spaces."""
    return int(_fingerprint(text.encode(), shingle))


def _fingerprint(text: bytes, shingle: int) -> np.uint64:
    words = text.lower().split()
    if not words:
        return np.uint64(0)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return of_hashes(np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=len(grams)))


def of_hashes(hashes: np.ndarray) -> np.uint64:
    """The bits set in more than half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.bitwise_or.reduce(np.where(ones * 2 > len(hashes), np.uint64(1) << _BITS, np.uint64(0)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a long), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_fingerprint(t.as_py().encode(), shingle) for t in batch.column(1)]
            fps = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


# --- the tree -----------------------------------------------------------------------


def _distance(values: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ point).astype(np.int16)


def _vantage(values: np.ndarray, tries: int = 8) -> tuple[np.uint64, int, np.ndarray] | None:
    """The candidate that splits ``values`` best: point, radius, distances; None if none does."""
    best = None
    for point in values[np.linspace(0, len(values) - 1, tries).astype(int)]:
        far = _distance(values, point)
        inner = np.bincount(far, minlength=65).cumsum()
        radius = int(np.argmin(np.abs(inner[:64] * 2 - len(values))))
        uneven = abs(int(inner[radius]) * 2 - len(values))
        near = int(((far > radius - RADIUS) & (far <= radius)).sum())
        if inner[radius] in (0, len(values)):
            continue
        if best is None or uneven + near < best[0]:
            best = (uneven + near, point, radius, far)
    return best and best[1:]


def layout(sample: np.ndarray, depth: int) -> list[tuple[int, int] | None]:
    """A heap of (vantage point, radius); None where a node is a leaf above ``depth``."""
    heap: list[tuple[int, int] | None] = [None] * (2 ** (depth + 1))
    todo = [(1, sample)]
    while todo:
        node, values = todo.pop()
        if node >= 2**depth or len(values) < 2 or (split := _vantage(values)) is None:
            continue
        point, radius, far = split
        heap[node] = (int(point), radius)
        todo += [(2 * node, values[far <= radius]), (2 * node + 1, values[far > radius])]
    return heap


def _route(values: np.ndarray, heap: list, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, its own values, values that only ask there)."""
    todo = [(1, values, values[:0])]
    while todo:
        node, own, asks = todo.pop()
        if not len(own) and not len(asks):
            continue
        if heap[node] is None:
            yield node, own, asks
            continue
        point, bound = np.uint64(heap[node][0]), heap[node][1]
        for side in _halves(own, asks, point, bound, radius):
            node_of = 2 * node if side[0] == "in" else 2 * node + 1
            todo.append((node_of, side[1], side[2]))


def _halves(own, asks, point, bound: int, radius: int):
    """Own values go to one side; those inside near the boundary also ask outside."""
    far, ask = _distance(own, point), _distance(asks, point)
    yield "in", own[far <= bound], asks[ask - radius <= bound]
    near = own[(far <= bound) & (far + radius > bound)]
    yield "out", own[far > bound], np.concatenate([near, asks[ask + radius > bound]])


def links(own: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``own`` and between ``own`` and ``asks``."""
    forest = Forest(np.concatenate([own, asks]))
    todo = [(own, asks)]
    while todo:
        own, asks = todo.pop()
        if not len(own) or len(own) + len(asks) < 2:
            continue
        split = _vantage(own) if len(own) > SMALL else None
        if split is not None:
            parts = [(o, a) for _, o, a in _halves(own, asks, split[0], split[1], radius)]
            if max(len(o) for o, _ in parts) < 0.95 * len(own):
                todo += parts
                continue
        every = np.concatenate([own, asks])
        for start in range(0, len(own), SMALL):
            block = own[start : start + SMALL]
            for at in range(start, len(every), 1 << 14):
                other = every[at : at + (1 << 14)]
                x, y = np.nonzero(np.bitwise_count(block[:, None] ^ other[None, :]) <= radius)
                forest.join(block[x], other[y])
    return forest.tied()


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: links that connect all values of ``fp`` (distinct longs) within ``radius``."""
    total = fps.count()
    depth = 0
    while total > LEAF * 2**depth and depth < 20:
        depth += 1
    rows = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect() if depth else []
    sample = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    heap = layout(sample, min(depth, 12))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for leaf, own, asks in _route(values, heap, radius):
                every = np.concatenate([own, asks]).view(np.int64)
                asked = np.repeat([False, True], [len(own), len(asks)])
                yield pd.DataFrame({"leaf": leaf, "fp": every, "asks": asked})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        values, asked = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["asks"].to_numpy(bool)
        a, b = links(values[~asked], np.unique(values[asked]), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.mapInPandas(deal, "leaf long, fp long, asks boolean")
    return dealt.groupBy("leaf").applyInPandas(search, "a long, b long")


def clusters(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for rows of ``doc_id, fp`` (read twice: stage them first)."""
    distinct = stage(
        fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-fps"
    )
    roots = components(linked(distinct.select("fp"), radius), "simhash-links")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    sizes = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    total = distinct.agg(F.count("*"), F.sum("n")).first()
    table = hot_join(named, sizes, "root", "m", total[0]).select("fp", "n", "component_id")
    return hot_join(fps, stage(table, "simhash-classes"), "fp", "n", total[1] or 0)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``."""
    return clusters(stage(fingerprints(docs, shingle), "simhash"), radius)
