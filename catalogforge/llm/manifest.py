"""A Merkle manifest of a dataset, kept as a log of nodes in the order of their completion.

Every row is a leaf. Leaves of a source in ``doc_id`` order form a tree of ``FAN``
children a node, and the roots of the sources form one more. A tree is built by aligned
builders: a builder takes ``FAN`` ** ``DEPTH`` neighbouring nodes of one level, so its
subtree is whole wherever it stands, and writes each node when its last child is there.
The next round's builders start from the roots of those subtrees.

A node's place in its tree's log is its place in postorder, which needs no counting: ``e``
leaves complete ``sum(e // FAN**j)`` nodes of full size, whoever else builds. So the siblings
of a node are addressed by arithmetic, and a proof reads its own run of each level.

Defined cases: each null field is a ``-`` of its own in the leaf, unlike an empty one; a
null source has its own tree, which comes first; a null ``doc_id`` comes first in its
source, and rows that repeat are leaves each; an empty table gives an empty result; a text
of any length becomes one digest where it is read; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge.operators.ordering import global_positions, group_positions
from catalogforge.session import stage

FAN = 16
# Levels that a builder adds to those it is given.
DEPTH = 2
BUILDER = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5

NODES = (
    "tree string, block long, position long, level int, index long, digest binary, leaves long, "
    "doc_id long, tampered binary"
)
_NODES = pa.schema(
    [
        ("tree", pa.string()), ("block", pa.int64()), ("position", pa.int64()), ("level", pa.int32()),
        ("index", pa.int64()), ("digest", pa.binary()), ("leaves", pa.int64()), ("doc_id", pa.int64()), ("tampered", pa.binary()),
    ]
)


def combined(digests: list[bytes]) -> bytes:
    """The node above ``digests``: SHA-256 of their hexadecimal texts, one after the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def position(level: int, index: int, leaves: int) -> int:
    """Place (from 0) of a node in the log of a tree that has ``leaves`` leaves.

    A full node follows all nodes that end no later, save those above it. What the
    last leaves leave unfinished is closed at the end, lowest level first.
    """
    end = (index + 1) * FAN**level
    if end <= leaves:
        here = sum(end // FAN**j for j in range(level + 1)) - 1
        above, j = 0, level + 1
        while FAN**j < end:
            above, j = above + (end - 1) // FAN**j, j + 1
        return here + above
    full, j = 0, 0
    while FAN**j <= leaves:
        full, j = full + leaves // FAN**j, j + 1
    return full + sum(1 for j in range(1, level) if leaves % FAN**j)


def siblings(level: int, index: int, count: int) -> list[int]:
    """Indexes of the run that ``index`` is in, on a level of ``count`` nodes."""
    first = index - index % FAN
    return list(range(first, min(first + FAN, count)))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, digest, tampered``: the leaf of each row, and of what tampering makes of it.

    ``tampered`` is null where nothing is touched. The tree of a null source is empty text.
    """
    text = F.col("text")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    head = F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]])
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        _digest(F.concat(head, _field(text))).alias("digest"),
        F.when(touched, _digest(F.concat(head, _field(lowered)))).alias("tampered"),
    )


def build(nodes: DataFrame, base: int) -> DataFrame:
    """The log (``NODES``) of nodes (``tree, index, digest, leaves, doc_id, tampered``) of level ``base``.

    ``leaves`` counts those below a node; all but the last of a tree are full. Each builder closes what it begins. One that is not full holds the end of its tree, so
    it knows how many leaves there are; a tree of one builder stops at its root.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        rows = sorted(table.to_pylist(), key=lambda r: r["index"])
        n = block * BUILDER + len(rows)
        below = block * BUILDER * FAN**base + sum(r["leaves"] for r in rows)
        out: list[dict] = []

        def add(level: int, index: int, digest: bytes, **given) -> None:
            place = position(base + level, index, below)
            node = {"tree": tree, "block": block, "position": place, "level": base + level}
            out.append(node | {"index": index, "digest": digest} | given)

        def close(level: int) -> None:
            index = n_closed[level]
            n_closed[level] += 1
            digest = combined(open_[level - 1])
            open_[level - 1] = []
            add(level, index, digest)
            open_[level].append(digest)

        open_: list[list[bytes]] = [[] for _ in range(DEPTH + 1)]
        n_closed = [block * BUILDER // FAN**j for j in range(DEPTH + 1)]
        for at, row in enumerate(rows):
            given = {c: row[c] for c in ("leaves", "doc_id", "tampered")}
            add(0, block * BUILDER + at, row["digest"], **given)
            open_[0].append(row["digest"])
            for level in range(1, DEPTH + 1):
                if len(open_[level - 1]) < FAN:
                    break
                close(level)
        top = DEPTH
        if not block:
            top = next(j for j in range(DEPTH + 1) if FAN**j >= n)
        for level in range(1, top + 1):
            if open_[level - 1]:
                close(level)
        return pa.Table.from_pylist(out, _NODES)

    dealt = nodes.withColumn("block", F.expr(f"index div {BUILDER}"))
    return dealt.groupBy("tree", "block").applyInArrow(run, NODES)


def _roots(log: DataFrame) -> DataFrame:
    """``tree, block, digest, leaves``: what each builder leaves open, its topmost node."""
    top = F.max_by("digest", "level").alias("digest")
    return log.groupBy("tree", "block").agg(top, F.sum("leaves").alias("leaves"))


def _forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The logs of all rounds, and ``tree, digest``: the root of each tree."""
    logs: list[DataFrame] = []
    done: DataFrame | None = None
    while True:
        logs.append(stage(build(nodes, DEPTH * len(logs)), "manifest-log"))
        roots = stage(_roots(logs[-1]), "manifest-roots")
        several = roots.filter("block > 0").select("tree").distinct()
        single = roots.join(several, "tree", "left_anti").select("tree", "digest")
        done = single if done is None else done.unionByName(single)
        rest = roots.join(several, "tree", "left_semi")
        if rest.isEmpty():
            return logs, stage(done, "manifest-subroots")
        nodes = rest.select(
            "tree",
            F.col("block").alias("index"),
            "digest",
            "leaves",
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("binary").alias("tampered"),
        )


# A path is a row of steps from the bottom up: place in the run, nodes in it, and the others.
def _step(at: int, run: list[bytes]) -> bytes:
    return bytes([at, len(run)]) + b"".join(run[:at] + run[at + 1 :])


def _steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    start = 0
    while start < len(path):
        at, count = path[start], path[start + 1]
        start += 2
        yield at, [path[start + 32 * i : start + 32 * i + 32] for i in range(count - 1)]
        start += 32 * (count - 1)


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that ``digest`` leads to along ``path``."""
    for at, others in _steps(path):
        digest = combined([*others[:at], digest, *others[at:]])
    return digest


def proof(path: bytes) -> str:
    """SHA-256 of all siblings of ``path``, from the leaf's run up, left to right."""
    digests = (d.hex() for _, others in _steps(path) for d in others)
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Slice:
    """A builder's part of the log, read by place."""

    def __init__(self, rows: list[dict], base: int, block: int):
        self.block, self.base = block, base
        self.log = {r["position"]: r["digest"] for r in rows}
        self.given = [r for r in rows if r["level"] == base]
        self.n = block * BUILDER + len(self.given)
        self.leaves = block * BUILDER * FAN**base + sum(r["leaves"] for r in self.given)
        self.levels = max(r["level"] for r in rows) - base

    def path(self, index: int) -> bytes:
        """Steps from a given node to the builder's topmost one."""
        out = b""
        for level in range(self.levels):
            here = index // FAN**level
            run = siblings(level, here, -(-self.n // FAN**level))
            places = (position(self.base + level, i, self.leaves) for i in run)
            out += _step(here - run[0], [self.log[p] for p in places])
        return out


def _descend(log: DataFrame, above: DataFrame, base: int) -> DataFrame:
    """``tree, block, path`` of the builders one round below, for ``tree, block, path`` of this one."""

    def run(key: tuple, nodes: pa.Table, paths: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        rows, up = nodes.to_pylist(), paths.column("path").to_pylist()[0]
        part = Slice(rows, base, block)
        found = [(tree, r["index"], part.path(r["index"]) + up) for r in part.given]
        columns = zip(*found, strict=True)
        return pa.table(dict(zip(["tree", "block", "path"], map(list, columns), strict=True)))

    pairs = log.groupBy("tree", "block").cogroup(above.toDF(*above.columns).groupBy("tree", "block"))
    return pairs.applyInArrow(run, "tree string, block long, path binary")


def _tops(log: DataFrame, paths: DataFrame) -> DataFrame:
    """``tree, block 0, path`` for the trees of ``paths`` (``tree, path``) that end in ``log``."""
    blocks = log.groupBy("tree").agg(F.max("block").alias("last")).filter("last = 0")
    return blocks.join(paths, "tree").select("tree", F.lit(0).cast("long").alias("block"), "path")


class Manifest:
    """The logs of a dataset: of its sources' trees by round, and of the tree above them."""

    def __init__(self, docs: DataFrame):
        order = ["doc_id", "digest"]
        numbered = group_positions(leaves(docs), ["tree"], order, "index")
        one = F.lit(1).cast("long").alias("leaves")
        self.rounds, self.subroots = _forest(numbered.select("*", one).withColumn("index", F.col("index") - 1))
        ordered = global_positions(self.subroots, ["tree"], "index")
        self.order = stage(ordered.withColumn("index", F.col("index") - 1), "manifest-order")
        tops = self.order.select(
            F.lit("").alias("tree"),
            "index",
            "digest",
            one,
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("binary").alias("tampered"),
        )
        self.top_rounds, self.root = _forest(tops)

    def _paths(self, rounds: list[DataFrame], tops: DataFrame, last: int) -> DataFrame:
        """``tree, block, path`` of the builders of round ``last`` and below all ``tops``."""
        above: DataFrame | None = None
        for number in range(len(rounds) - 1, last - 1, -1):
            here = _tops(rounds[number], tops)
            below = here if above is None else here.unionByName(above)
            if number == last:
                return below
            above = stage(_descend(rounds[number], below, DEPTH * number), "manifest-paths")
        raise ValueError("no such round")

    def source_paths(self) -> DataFrame:
        """``tree, path``: from each source's root to the root of all."""
        start = self.root.select("tree", F.lit(b"").alias("path"))
        blocks = self._paths(self.top_rounds, start, 0)
        found = _descend(self.top_rounds[0], blocks, 0).select(F.col("block").alias("index"), "path")
        return stage(self.order.join(found, "index").select("tree", "path"), "manifest-tops")

    def checks(self) -> DataFrame:
        """Of every row ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

        The tampered leaf, where there is one, is folded along the siblings of the log.
        """
        tops = self.source_paths()
        blocks = self._paths(self.rounds, tops, 0)
        known = blocks.join(self.subroots.withColumnRenamed("digest", "subroot"), "tree")
        top = self.root.select("digest").first()
        root = top["digest"].hex() if top else ""

        def run(key: tuple, nodes: pa.Table, paths: pa.Table) -> pa.Table:
            block = key[1].as_py()
            up = paths.to_pylist()[0]
            part = Slice(nodes.to_pylist(), 0, block)
            out = []
            for row in part.given:
                path = part.path(row["index"]) + up["path"]
                folded = fold(row["tampered"] or row["digest"], path).hex()
                out.append(
                    {
                        "doc_id": row["doc_id"],
                        "leaf": row["digest"].hex(),
                        "subroot": up["subroot"].hex(),
                        "root": root,
                        "proof_sha256": proof(path),
                        "folded_root": folded,
                        "verified": folded == root,
                    }
                )
            return pa.Table.from_pylist(out, _CHECKS)

        paths = known.toDF(*known.columns).groupBy("tree", "block")
        pairs = self.rounds[0].groupBy("tree", "block").cogroup(paths)
        return pairs.applyInArrow(run, CHECKS)

    def write(self, out: str) -> None:
        """The log below ``out`` as Parquet: ``sources`` in postorder of each tree, and ``top``."""
        for name, rounds in (("sources", self.rounds), ("top", self.top_rounds)):
            for number, log in enumerate(rounds):
                # What a later round is given stands in the log of the round before.
                own = log.filter(F.col("level") > DEPTH * number) if number else log
                ordered = own.repartitionByRange("tree", "block").sortWithinPartitions("tree", "block", "position")
                ordered.write.parquet(f"{out}/{name}/round={number}")


CHECKS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)
_CHECKS = pa.schema(
    [
        ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
        ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
    ]
)
