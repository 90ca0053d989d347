"""Removal of repeated byte strings by suffix arrays, over a corpus of any size.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier, in a
smaller ``doc_id`` or further ahead in the same text. Only windows that can repeat are
ever compared:

1. Every window has an anchor, the 32-byte gram of least hash in it. Equal windows have
   equal anchors at equal offsets. Neighbouring windows with one anchor are a unit, cut
   out as one piece of text. Documents are dealt to shards, and a shard reports each of
   its anchors once; anchors that occur once in the whole corpus rule their windows out.
2. Units of all other anchors are dealt by anchor to buckets, so equal windows meet. A
   bucket builds a suffix array of its distinct units (Larsson-Sadakane refinement by
   packed sorts in numpy), takes common prefixes as Kasai does (a pair that moves along
   with its predecessor is one shorter), and windows in runs of ``LENGTH`` or more are
   equal: all but the first in document order are repeats.
3. An anchor of more than ``HEAVY`` units is spread over several buckets. Each passes on
   the first of its equal windows in sorted order, and these sorted runs are merged by
   binary search.
4. What each document repeats goes back to its shard, and what remains is hashed.

Texts are shuffled once; one exchange feeds the first, the second and the last step.

Defined cases: null texts count as empty; shorter texts than ``LENGTH`` keep all bytes; a
null ``doc_id`` comes after all others; documents of one ``doc_id`` follow one another by
hash of their texts; rows equal in both are one document and each get its result; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogforge.llm.common import texts

LENGTH = 100
GRAM = 32
# Bytes of text in a shard, of units in a bucket, and of text hashed at a time.
SHARD, BUCKET, SLICE = 4 << 20, 3 << 19, 1 << 20
# Units of one anchor that a bucket takes.
HEAVY = 8192
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = 2**63 - 1


class _Powers:
    """Powers of an odd multiplier and of its inverse, to hash any range from prefix sums."""

    size = 0

    @classmethod
    def up_to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            up = np.full(n, _MULTIPLIER, np.uint64)
            down = np.full(n, pow(int(_MULTIPLIER), -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down, cls.size = np.cumprod(up), np.cumprod(down), n
        return cls.up[:n], cls.down[:n]


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _Powers.up_to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _Powers.up_to(len(sums))
    mixed = (sums[ends] - sums[starts]) * down[starts]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MULTIPLIER
    return mixed ^ (mixed >> np.uint64(29))


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: start, windows, anchor hash and own hash of each unit."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    sums = _sums(data)
    at = np.arange(n - GRAM + 1)
    grams = _hash(sums, at, at + GRAM)
    width = LENGTH - GRAM + 1
    bits = np.uint64(max(1, int(n).bit_length()))
    least = ((grams >> bits) << bits) | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        step = width - span
        least = np.minimum(least[:-step], least[step:])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.concatenate([start, [len(anchor)]]))
    own = _hash(sums, start, start + count + (LENGTH - 1))
    return start, count, grams[anchor[start]], own


# --- suffix arrays ----------------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes at least, by refinement.

    Larsson and Sadakane: the order by h bytes, kept as ranks, gives the order by 2h;
    groups of one suffix are done and never looked at again.
    """
    n = len(data)
    bits = np.uint64(max(1, int(n).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    h = min(5, int(64 - bits) // 8)
    padded = np.concatenate([data, np.zeros(h, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = (key << np.uint64(8)) | padded[i : n + i]
    key = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
    order = (key & mask).astype(np.int64)
    rank = np.zeros(n + 1, np.int64)  # the rank beyond the end is 0, below all others
    edge = np.concatenate([[True], (key[1:] >> bits) != (key[:-1] >> bits)])
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(edge, place, 0)) + 1
    while h < depth:
        # Places in groups of more than one.
        single = edge & np.concatenate([edge[1:], [True]])
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        suffix = order[open_]
        group, second = rank[suffix], rank[np.minimum(suffix + h, n)]
        if 3 * int(bits) <= 63:
            b = bits
            packed = (group.astype(np.uint64) << (b + b)) | (second.astype(np.uint64) << b)
            packed = np.sort(packed | suffix.astype(np.uint64))
            suffix = (packed & mask).astype(np.int64)
            pair = packed >> b
            cut = np.concatenate([[True], pair[1:] != pair[:-1]])
        else:
            turn = np.lexsort((second, group))
            suffix, group, second = suffix[turn], group[turn], second[turn]
            cut = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        order[open_] = suffix
        edge[open_] = cut
        rank[suffix] = np.maximum.accumulate(np.where(cut, open_, 0)) + 1
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, up to ``limit``, of each suffix in ``order`` with the one before it.

    Kasai: if the suffix before i + 1 is the one before i moved by a byte, their common
    prefix is one shorter and need not be counted again. Only the others are compared,
    eight bytes at a time.
    """
    n = len(data)
    before = np.full(n + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    inside = np.zeros(n + 1, bool)
    inside[order] = True
    at = np.sort(order)
    carried = inside[at - 1] & (at > 0) & (before[at] == before[at - 1] + 1) & (before[at - 1] >= 0)
    fresh = at[~carried & (before[at] >= 0)]
    padded = np.concatenate([data, np.zeros(limit + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = np.zeros(n + 1, np.int64)
    live, step = fresh, 0
    while len(live) and step < limit:
        a = np.ascontiguousarray(words[live + step]).view("<u8").ravel()
        b = np.ascontiguousarray(words[before[live] + step]).view("<u8").ravel()
        odd = a ^ b
        low = odd & (~odd + np.uint64(1))
        same = np.where(odd == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        length[live] += np.minimum(same, limit - step)
        live, step = live[odd == 0], step + 8
    # Bytes beyond the end are not common.
    length[fresh] = np.minimum(length[fresh], n - np.maximum(fresh, before[fresh]))
    # What is carried is the last fresh count, less the way from there.
    base = np.maximum.accumulate(np.where(carried, 0, np.arange(len(at))))
    full = np.maximum(length[at[base]] - (at - at[base]), 0)
    length[at] = full
    return length[order]


def repeats(pieces: list[bytes], counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows of distinct units: for each window its unit, offset, and the least
    place (a whole number of its document's and its own order) of the windows equal to it."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = counts + LENGTH - 1
    begin = np.cumsum(sizes) - sizes
    unit = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
    spot = begin[unit] + offset
    window = np.full(len(data), -1, np.int64)
    window[spot] = np.arange(len(spot))
    order = suffix_array(data)
    order = order[window[order] >= 0]
    # A window moves along with its predecessor for less than the width of a unit.
    shared = common_prefixes(data, order, LENGTH + (LENGTH - GRAM + 1))
    starts = np.flatnonzero(np.concatenate([[True], shared[1:] < LENGTH]))
    found = window[order]
    place = places[unit] + offset
    least = np.minimum.reduceat(place[found], starts)
    first = np.zeros(len(found), np.int64)
    first[found] = np.repeat(least, np.diff(np.concatenate([starts, [len(found)]])))
    return unit, offset, first


# --- on Spark ---------------------------------------------------------------------------

UNIT = pa.schema(
    [
        ("bucket", pa.int64()), ("heavy", pa.bool_()), ("anchor", pa.int64()), ("own", pa.int64()),
        ("shard", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()),
        ("count", pa.int32()), ("piece", pa.binary()),
    ]
)
FOUND = pa.schema(
    [
        ("part", pa.int64()), ("anchor", pa.int64()), ("window", pa.int64()), ("shard", pa.int64()),
        ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("end", pa.int32()),
    ]
)
KEPT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("kept", pa.binary()),
    ]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _documents(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(order of the id, order of the text, bytes) of the rows of a shard."""
    ids, values = table.column("doc_id").to_pylist(), table.column("text")
    for doc_id, text in zip(ids, values, strict=True):
        raw = text.as_py().encode()
        tie = int.from_bytes(hashlib.blake2b(raw, digest_size=7).digest())
        yield _NO_ID if doc_id is None else doc_id, tie, np.frombuffer(raw, np.uint8)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _anchors(table: pa.Table) -> pa.Table:
    shard = table.column("shard")[0].as_py()
    found = [units(data)[2] for _, _, data in _documents(table)]
    values, counts = np.unique(np.concatenate(found), return_counts=True)
    return pa.table(
        {
            "anchor": values.view(np.int64),
            "shard": np.full(len(values), shard),
            "n": counts.astype(np.int64),
        }
    )


def _cut(buckets: int, most: int):
    def cut(table: pa.Table, known: pa.Table) -> pa.Table:
        """Units of a shard whose anchors repeat; of equal units the first, the rest as repeats."""
        if not table.num_rows or not known.num_rows:
            return UNIT.empty_table()
        shard = table.column("shard")[0].as_py()
        anchors = known.column("anchor").to_numpy().view(np.uint64)
        turn = np.argsort(anchors)
        anchors, totals = anchors[turn], known.column("total").to_numpy()[turn]
        docs = sorted(_documents(table), key=lambda d: d[:2])
        seen = []
        for at, (_, _, data) in enumerate(docs):
            start, count, anchor, own = units(data)
            place = np.minimum(np.searchsorted(anchors, anchor), len(anchors) - 1)
            keep = anchors[place] == anchor
            if keep.any():
                parts = (start[keep], count[keep], anchor[keep], own[keep], totals[place[keep]])
                seen.append((np.full(int(keep.sum()), at), *parts))
        if not seen:
            return UNIT.empty_table()
        at, start, count, anchor, own, total = map(np.concatenate, zip(*seen, strict=True))
        # Already in document order: the first of equal units is the earliest.
        _, first, which = np.unique(
            np.stack([anchor, own ^ count.astype(np.uint64)], axis=1),
            axis=0, return_index=True, return_inverse=True,
        )
        which = which.ravel()
        doc, tie = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
        origin = first[which]
        same = (start == start[origin]) & (doc[at] == doc[at[origin]]) & (tie[at] == tie[at[origin]])
        later = ~same
        fresh = np.sort(first)
        heavy = total[fresh] > most
        salt = shard % (total[fresh] // most + 1)
        mixed = anchor[fresh].view(np.int64)
        bucket = np.where(heavy, (mixed ^ (salt * 0x9E3779B1)) | np.int64(-(2**63)), mixed % buckets)
        cut_out = [
            docs[d][2][s : s + c + LENGTH - 1].tobytes()
            for d, s, c in zip(at[fresh], start[fresh], count[fresh], strict=True)
        ]
        new = pa.table(
            {
                "bucket": bucket, "heavy": heavy, "anchor": mixed, "own": own[fresh].view(np.int64),
                "shard": np.full(len(fresh), shard), "doc": doc[at[fresh]], "tie": tie[at[fresh]],
                "start": start[fresh].astype(np.int32), "count": count[fresh].astype(np.int32),
                "piece": pa.array(cut_out, pa.binary()),
            }
        )
        rest = np.flatnonzero(later)
        # Units of one document that touch are one stretch.
        touch = np.zeros(len(rest), bool)
        touch[1:] = (at[rest[1:]] == at[rest[:-1]]) & (
            start[rest[1:]] <= start[rest[:-1]] + count[rest[:-1]] + LENGTH - 1
        )
        heads = np.flatnonzero(~touch)
        tails = np.concatenate([heads[1:], [len(rest)]])[: len(heads)] - 1
        a, b = rest[heads], rest[tails]
        old = pa.table(
            {
                "bucket": np.full(len(a), shard % buckets), "heavy": np.zeros(len(a), bool),
                "anchor": np.zeros(len(a), np.int64), "own": np.zeros(len(a), np.int64),
                "shard": np.full(len(a), shard), "doc": doc[at[a]], "tie": tie[at[a]],
                "start": start[a].astype(np.int32),
                "count": (start[b] + count[b] - start[a]).astype(np.int32),
                "piece": pa.nulls(len(a), pa.binary()),
            }
        )
        return pa.concat_tables([new.cast(UNIT), old.cast(UNIT)])

    return cut


def _rows(part, anchor, window, shard, doc, tie, start, end) -> pa.Table:
    columns = (part, anchor, window, shard, doc, tie, start, end)
    arrays = [pa.array(np.asarray(c).astype(f.type.to_pandas_dtype())) for c, f in zip(columns, FOUND, strict=True)]
    return pa.Table.from_arrays(arrays, schema=FOUND)


def _search(parts: int):
    def search(table: pa.Table) -> pa.Table:
        """Repeated stretches in a bucket, and for heavy anchors the first of equal windows."""
        done = table.filter(pc.is_null(table.column("piece")))
        table = table.filter(pc.is_valid(table.column("piece")))
        c = {n: done.column(n).to_numpy() for n in ("shard", "doc", "tie", "start", "count")}
        zero = np.zeros(len(c["doc"]), np.int64)
        end = c["start"] + c["count"] + LENGTH - 1
        out = [_rows(c["shard"] % parts, zero, zero, c["shard"], c["doc"], c["tie"], c["start"], end)]
        if table.num_rows:
            out += _judge(table, parts)
        return pa.concat_tables(out)

    return search


def _judge(table: pa.Table, parts: int) -> list[pa.Table]:
    names = ("heavy", "anchor", "own", "shard", "doc", "tie", "start", "count")
    c = {n: table.column(n).to_numpy() for n in names}
    # Documents in order; a place is the document's number and the position in it.
    turn = np.lexsort((c["start"], c["tie"], c["doc"]))
    c = {n: v[turn] for n, v in c.items()}
    new = np.concatenate([[True], (c["doc"][1:] != c["doc"][:-1]) | (c["tie"][1:] != c["tie"][:-1])])
    place = (np.cumsum(new).astype(np.int64) << 32) | c["start"]
    keys = np.stack([c["anchor"], c["own"], c["count"].astype(np.int64)], axis=1)
    _, first, which = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    which = which.ravel()
    pieces = table.column("piece").take(pa.array(turn[first])).to_pylist()
    unit, offset, least = repeats(pieces, c["count"][first].astype(np.int64), place[first])
    own = place[first][unit] + offset
    repeated = least < own
    # Runs of repeats in the first unit of its kind; all of a later one repeats.
    edge = np.concatenate([[True], unit[1:] != unit[:-1]])
    begins = repeated & (edge | ~np.concatenate([[False], repeated[:-1]]))
    ends = repeated & np.concatenate([edge[1:] | ~repeated[1:], [True]])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    row = first[unit[a]]
    shard, zero = c["shard"][row], np.zeros(len(row), np.int64)
    start = c["start"][row] + offset[a]
    stop = c["start"][row] + offset[b] + LENGTH
    out = [_rows(shard % parts, zero, zero, shard, c["doc"][row], c["tie"][row], start, stop)]
    later = np.flatnonzero(place > place[first][which])
    if len(later):
        shard, zero = c["shard"][later], np.zeros(len(later), np.int64)
        stop = c["start"][later] + c["count"][later] + LENGTH - 1
        out.append(
            _rows(shard % parts, zero, zero, shard, c["doc"][later], c["tie"][later], c["start"][later], stop)
        )
    passed = np.flatnonzero(c["heavy"][first][unit] & ~repeated)
    if len(passed):
        row = first[unit[passed]]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = c["count"][first].astype(np.int64) + LENGTH - 1
        spot = (np.cumsum(sizes) - sizes)[unit[passed]] + offset[passed]
        window = _hash(_sums(data), spot, spot + LENGTH).view(np.int64)
        at = c["start"][row] + offset[passed]
        # Bit 62 keeps merged windows apart from stretches, which have part numbers.
        part = (window & np.int64(2**62 - 1)) % parts
        out.append(
            _rows(part, c["anchor"][row], window | 1, c["shard"][row], c["doc"][row], c["tie"][row], at, np.zeros(len(at)))
        )
    return out


def _merge(table: pa.Table) -> pa.Table:
    """Merges the windows that buckets of heavy anchors passed on; stretches go through."""
    whole = pc.equal(table.column("window"), 0)
    out, table = [table.filter(whole)], table.filter(pc.invert(whole))
    if table.num_rows:
        c = {n: table.column(n).to_numpy() for n in FOUND.names}
        turn = np.lexsort((c["start"], c["tie"], c["doc"]))
        c = {n: v[turn] for n, v in c.items()}
        key = c["anchor"] ^ (c["window"] * np.int64(0x5851F42D4C957F2D))
        sorted_keys = np.unique(key)
        # Each run looks its windows up in the merged order.
        slot = np.searchsorted(sorted_keys, key)
        first = np.full(len(sorted_keys), len(key))
        np.minimum.at(first, slot, np.arange(len(key)))
        origin = first[slot]
        later = (c["doc"] != c["doc"][origin]) | (c["tie"] != c["tie"][origin]) | (c["start"] != c["start"][origin])
        c = {n: v[later] for n, v in c.items()}
        # Windows that follow one another are one stretch.
        near = np.zeros(len(c["doc"]), bool)
        near[1:] = (
            (c["doc"][1:] == c["doc"][:-1]) & (c["tie"][1:] == c["tie"][:-1])
            & (c["start"][1:] <= c["start"][:-1] + LENGTH)
        )
        heads = np.flatnonzero(~near)
        tails = np.concatenate([heads[1:], [len(near)]])[: len(heads)] - 1
        zero = np.zeros(len(heads), np.int64)
        ids = [c[n][heads] for n in ("shard", "doc", "tie", "start")]
        out.append(_rows(zero, zero, zero, *ids, c["start"][tails] + LENGTH))
    return pa.concat_tables(out)


def _keep(table: pa.Table, found: pa.Table) -> pa.Table:
    """What is left of the texts of a shard."""
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    columns = [found.column(n).to_pylist() for n in ("doc", "tie", "start", "end")]
    for doc, tie, start, end in zip(*columns, strict=True):
        spans.setdefault((doc, tie), []).append((start, end))
    rows: list[list] = [[], [], [], [], []]
    ids = table.column("doc_id").to_pylist() if table.num_rows else []
    for doc_id, (doc, tie, data) in zip(ids, _documents(table), strict=True):
        gone = np.zeros(len(data) + 1, np.int32)
        for start, end in spans.get((doc, tie), ()):
            gone[start] += 1
            gone[end] -= 1
        flags = np.cumsum(gone[:-1]) > 0
        values = (doc_id, len(data), int(flags.sum()), len(_runs(flags)[0]), data[~flags].tobytes())
        for column, value in zip(rows, values, strict=True):
            column.append(value)
    return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(rows, KEPT, strict=True)], schema=KEPT)


def remove_repeats(
    docs: DataFrame, heavy: int = HEAVY, shard: int = SHARD, bucket: int = BUCKET
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and ``kept``, the bytes that stay, of every row.

    ``heavy``: units of an anchor from which it is spread; ``shard``, ``bucket``: bytes in each.
    """
    rows = texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = size // shard + 1, size // bucket + 1
    parts = buckets // 4 + 1
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    groups = dealt.groupBy("shard")
    anchors = groups.applyInArrow(_anchors, "anchor long, shard long, n long")
    every = Window.partitionBy("anchor")
    known = (
        anchors.withColumn("total", F.sum("n").over(every))
        .filter("total > 1")
        .select("shard", "anchor", "total")
    )
    cut = groups.cogroup(known.groupBy("shard")).applyInArrow(_cut(buckets, heavy), _ddl(UNIT))
    found = cut.groupBy("bucket").applyInArrow(_search(parts), _ddl(FOUND))
    merged = found.groupBy("part").applyInArrow(_merge, _ddl(FOUND))
    return groups.cogroup(merged.groupBy("shard")).applyInArrow(_keep, _ddl(KEPT))
