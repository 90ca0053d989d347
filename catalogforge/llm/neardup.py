"""One document of each group of near-duplicates, by SimHash and min-wise sketches.

SimHash links within two bits (``simhash.linked``) find texts that are almost equal.
Texts that share four fifths of their five-word shingles lie about eleven bits apart,
where a tree over 64 bits prunes nothing, so a second sketch proposes those pairs: bands
of min-wise hashes. Members of a band meet a few centres of it; those that are not tied then
meet where the rarest differences from a centre coincide, which leaves out no pair that is alike.
A proposed pair counts if its sets of shingles share ``similarity``.
Whole sketches only spare far pairs that comparison. Links of both kinds join in components, of which the smallest ``doc_id`` stays.

Defined cases: null texts count as empty, and all texts without words are one group; rows
that repeat are one document; a null ``doc_id`` counts as larger than any other; an empty
table gives an empty result; further columns are kept as they are. A text of any length
is sketched whole in the task that reads it; its set of shingles (8 bytes a word) is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogforge.llm import simhash
from catalogforge.llm.common import components, hot_join, short_batches, slices
from catalogforge.session import stage

SHINGLE = 5
SIMILARITY = 0.8
# Pairs whose sketches agree in this much less are decided too: four standard errors.
MARGIN = 0.15
PLACES = 128
BANDS, ROWS = 20, 6
# Pairs of one text beyond so many meet a further copy of what it is compared by.
SPLIT = 2000
# Members of a band that meet all others in the first round, and how their number grows.
CENTRES, GROWTH = 4, 4
SLICE = 4 << 20

# Punctuation that does not tell words apart.
_DROPPED = b".,;:!?\"'()*#%$&|"
_draws = np.random.default_rng(20240101)
_FACTORS = _draws.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draws.integers(0, 2**63, PLACES, dtype=np.uint64)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of a text (of all its words, if they are fewer)."""
    words = text.lower().translate(None, _DROPPED).split()
    if len(words) <= size:
        grams = [b" ".join(words)] if words else []
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, simhash.SEED) for g in grams), dtype="<u8", count=len(grams))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the hashes under each of ``PLACES`` orders, as 32 bits; all ones if none."""
    least = np.full(PLACES, 2**64 - 1, np.uint64)
    for start in range(0, len(hashes), 2048):
        part = hashes[start : start + 2048]
        np.minimum(least, (part[:, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def bands(places: np.ndarray) -> list[int]:
    digest = xxhash.xxh64_intdigest
    out = [digest(places[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(out, np.uint64).view(np.int64).tolist()


def sketches(rows: DataFrame) -> DataFrame:
    """``doc_id, th, fp, places, bands`` for rows of ``doc_id, th, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            fps, places, keys = [], [], []
            for text in batch.column(2):
                hashes = shingles(text.as_py().encode())
                fps.append(simhash.of_hashes(hashes))
                places.append(sketch(hashes))
                keys.append(bands(places[-1]))
            arrays = [
                batch.column(0),
                batch.column(1),
                pa.array(np.array(fps, np.uint64).view(np.int64)),
                pa.array([p.tobytes() for p in places], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "fp", "places", "bands"])

    return rows.mapInArrow(run, "doc_id long, th string, fp long, places binary, bands array<long>")


def _central(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, score`` of ``members``: how many sketches of ``members`` share its places, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(PLACES, dtype=np.int64) << np.int64(32)
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, PLACES)
            for at in range(0, len(ids), 512):
                keys = (values[at : at + 512].astype(np.int64) + place).ravel()
                owner = np.repeat(ids[at : at + 512], PLACES)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(keys)], ["node", "place"])

    spread = nodes.select("node", "places").join(members, "node", "left_semi").mapInArrow(run, "node long, place long")
    spread = stage(spread, "neardup-places")
    counts = spread.groupBy("place").agg(F.count("*").alias("n")).withColumn("with", F.col("n"))
    met = hot_join(spread, stage(counts, "neardup-counts"), "place", "n", spread.count())
    return met.groupBy("node").agg(F.sum("with").alias("score"))


def _joined(
    nodes: DataFrame,
    known: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    propose: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``node, root``: components of the ``known`` links and of all links within the bands.

    In rounds, members of a band that are not in one component yet meet centres of it;
    a centre has met all others and leaves. The first centres are those nearest to the
    sketches around them, later ones come from outside the largest component. Their number
    grows by ``GROWTH`` a round, and a band is done when what is left of it is one
    component, so two members either met or are tied.

    ``propose`` (from ``centre, node, root`` to pairs ``a, b`` of different roots, at least all
    that count) takes the place of the rounds after the first, and ends them.
    """
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    total = nodes.count() * BANDS
    found = keyed.groupBy("band").agg(F.count("*").alias("n")).withColumn("m", F.col("n"))
    shared = stage(found.filter("n > 1"), "neardup-bands")
    live = stage(hot_join(keyed, shared, "band", "n", total).filter("m IS NOT NULL"), "neardup-members")
    crowded = live.filter(F.col("m") > CENTRES + 1).select("node").distinct()
    scores = stage(_central(crowded, nodes), "neardup-scores")
    live = live.join(scores, "node", "left").select("band", "node", F.coalesce("score", F.lit(0)).alias("score"))
    live, links, most = stage(live, "neardup-live"), known, CENTRES
    decided: DataFrame | None = None
    while True:
        tied = components(links, "neardup-groups")
        named = stage(
            live.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node")), "neardup-named"
        )
        sizes = named.groupBy("band", "root").agg(F.count("*").alias("m"))
        bands_of = sizes.groupBy("band").agg(
            F.sum("m").alias("n"), F.max(F.struct("m", "root")).getField("root").alias("main"), F.count("*").alias("roots")
        )
        apart = stage(bands_of.filter("roots > 1").select("band", "n", "main"), "neardup-apart")
        if apart.isEmpty():
            return tied
        rest = stage(hot_join(named, apart, "band", "n", total).filter("main IS NOT NULL"), "neardup-rest")
        if decided is not None and propose is not None:
            known_centres = apart.select("band", "n").join(first, "band")
            around = hot_join(rest.select("band", "node", "root"), known_centres, "band", "n", total)
            fresh = propose(stage(around.select("centre", "node", "root").distinct(), "neardup-around"))
            fresh = stage(fresh.join(decided, ["a", "b"], "left_anti"), "neardup-pairs")
            links = tied.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verify(fresh))
            return components(stage(links, "neardup-links"), "neardup-groups")
        outside = [F.col("root") == F.col("main")] if most > CENTRES else []
        order = Window.partitionBy("band").orderBy(*outside, F.desc("score"), F.xxhash64("node"), "node")
        chosen = rest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        chosen = stage(chosen.select("band", "node", "root", "rank"), "neardup-chosen")
        first = chosen.filter("rank = 1").select("band", F.col("node").alias("centre"))
        centres = chosen.groupBy("band").agg(F.collect_list(F.struct("node", "root")).alias("centres"))
        table = stage(apart.select("band", "n").join(centres, "band"), "neardup-centres")
        met = hot_join(rest.select("band", "node", "root"), table, "band", "n", total)
        other = F.filter("centres", lambda c: c["root"] != F.col("root"))
        pairs = met.select(F.col("node").alias("b"), F.explode(other).alias("c")).select(F.col("c.node").alias("a"), "b")
        # A pair that another band has proposed before is decided.
        fresh = pairs.distinct() if decided is None else pairs.distinct().join(decided, ["a", "b"], "left_anti")
        fresh = stage(fresh, "neardup-pairs")
        decided = fresh if decided is None else decided.unionByName(fresh)
        new = stage(verify(fresh), "neardup-links")
        links = tied.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)
        live = rest.join(chosen, ["band", "node"], "left_anti").select("band", "node", "score")
        most *= GROWTH


def _fetched(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``a, b, x, y``: ``column`` of both nodes of each pair.

    A text of very many pairs has one copy of its column for every ``SPLIT`` of them; only
    the number of copies is ever broadcast.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    copies = stage(counts.select("a", "n", F.ceil(F.col("n") / SPLIT).cast("int").alias("copies")), "neardup-copies")
    salted = hot_join(pairs, copies, "a", "n", pairs.count()).select(
        "a", "b", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("salt")
    )
    known = table.select("node", column)
    left = known.withColumnsRenamed({"node": "a", column: "x"}).join(copies, "a")
    left = left.select("a", "x", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    right = known.withColumnsRenamed({"node": "b", column: "y"})
    return salted.join(left, ["a", "salt"]).join(right, "b").select("a", "b", "x", "y")


def _alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches agree in ``least`` of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, PLACES)
                for c in batch.columns[2:]
            )
            same = pa.array((x == y).mean(axis=1) >= least)
            yield batch.select([0, 1]).filter(same)

    return _fetched(pairs, nodes, "places").mapInArrow(run, "a long, b long")


def _shingled(rows: DataFrame) -> DataFrame:
    """``node, grams``: the distinct shingle hashes for rows of ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = [np.unique(shingles(t.as_py().encode())) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            values = np.concatenate(found).view(np.int64)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], ["node", "grams"])

    return rows.mapInArrow(run, "node long, grams array<long>")


def _jaccard(x: str, y: str) -> Column:
    """Shared share of two arrays without repeats; two empty ones are equal.

    Computed a row at a time, so no batch of pairs holds many arrays at once.
    """
    common = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - common
    return F.when(either == 0, 1.0).otherwise(common / either)


def _grams(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, repeated: bool) -> DataFrame:
    """``node, grams`` of the ``node``s wanted; ``rows`` (``th, text``) are read again for their texts.

    Texts meet the short rows of nodes in a hash join, so no task sorts texts. Only rows that
    are ``repeated`` can find a text twice; texts are sent a second time only for them.
    """
    named = nodes.select("node", "th", "doc_id").join(wanted, "node").hint("shuffle_hash")
    same = (rows["th"] == named["th"]) & rows["doc_id"].eqNullSafe(named["doc_id"])
    found = rows.join(named, same).select("node", "text")
    return stage(_shingled(found.dropDuplicates(["node"]) if repeated else found), "neardup-shingles")


def _verified(
    pairs: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: float, repeated: bool
) -> DataFrame:
    """The pairs whose sets of shingles share ``similarity``, of those whose sketches come near it."""
    near = stage(_alike(pairs, nodes, similarity - MARGIN), "neardup-near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    both = _fetched(near, _grams(wanted, nodes, rows, repeated), "grams")
    return both.filter(_jaccard("x", "y") >= similarity).select("a", "b")


def _proposed(around: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of different roots around one centre: all that share ``similarity``, few others.

    Texts around a centre have most shingles in common, so they are told apart by how they
    differ from it. With ``d`` shingles between a text and the centre, ``n`` shingles of its own
    and ``most = (n + m)(1 - s) / (1 + s)`` between two texts that are alike, the differences
    of these share ``(d + e - most) / 2``: one of the rarest ``(d - e + most) / 2 + 1`` of each.
    A text within that bound of the centre has met it and is tied to it, so one of a pair lies
    outside; it also holds that ``|d - e| <= most``, and the sizes differ by ``similarity`` at most.
    """
    share = (1 - similarity) / (1 + similarity)
    spare = 1e-6
    pairs = around.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    met = _fetched(pairs, grams, "grams").select(
        F.col("a").alias("centre"),
        F.col("b").alias("node"),
        F.size("x").alias("of_centre"),
        F.size("y").alias("n"),
        F.array_union(F.array_except("x", "y"), F.array_except("y", "x")).alias("away"),
    )
    met = stage(met.join(around, ["centre", "node"]).withColumn("d", F.size("away")), "neardup-away")
    each = met.select("centre", "node", "root", "of_centre", "n", "d", F.explode("away").alias("gram"))
    each = each.withColumn("key", F.xxhash64("centre", "gram")).drop("gram")
    held = each.groupBy("key").agg(F.count("*").alias("c")).withColumn("holders", F.col("c"))
    total = met.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    told = hot_join(each, stage(held, "neardup-holders"), "key", "c", total)
    order = Window.partitionBy("centre", "node").orderBy("holders", "key")
    placed = told.withColumn("at", F.row_number().over(order) - 1).drop("holders")
    most = F.col("n") * (1 + 1 / similarity) * share
    bound = (F.col("n") * similarity + F.col("of_centre")) * share
    tied = F.col("d") <= (F.col("n") + F.col("of_centre")) * share
    few = (F.col("d") + most - bound) / 2
    few = F.when(F.col("tied"), few).otherwise(F.least(few, most / 2))
    placed = placed.withColumn("tied", tied).filter(F.col("at") <= F.greatest(few, most) + spare)
    placed = stage(placed, "neardup-placed")
    left = placed.filter(F.col("at") <= few + spare)
    right = placed.filter(~F.col("tied") & (F.col("at") <= most + spare))
    right = right.select("key", *[F.col(c).alias(f"_{c}") for c in ("node", "root", "n", "d", "at")])
    apart = (F.col("n") + F.col("_n")) * share + spare
    common = F.least(F.col("d") - F.col("at"), F.col("_d") - F.col("_at"))
    smaller = (F.col("d") < F.col("_d")) | ((F.col("d") == F.col("_d")) & (F.col("node") < F.col("_node")))
    near = (
        (F.col("root") != F.col("_root"))
        & (F.col("tied") | smaller)
        & (F.abs(F.col("d") - F.col("_d")) <= apart)
        & (2 * common >= F.col("d") + F.col("_d") - apart)
    )
    found = left.join(right, (left["key"] == right["key"]) & near)
    return found.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def survivors(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, th`` of the documents that stay; ``th`` is the MD5 of the text."""
    short_batches(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("th"), text.alias("text"))
    drawn = stage(sketches(rows), "neardup-sketches")
    repeated = not drawn.groupBy("doc_id", "th").count().filter("count > 1").isEmpty()
    # Exact copies collapse first; a node is the smallest id of its text.
    ids = drawn.groupBy("th").agg(F.min("doc_id").alias("doc_id"))
    match = (drawn["th"] == ids["th"]) & drawn["doc_id"].eqNullSafe(ids["doc_id"])
    nodes = stage(
        drawn.join(ids, match, "left_semi")
        .dropDuplicates(["th"])
        .withColumn("node", F.coalesce("doc_id", F.lit(2**63 - 1) - F.pmod(F.xxhash64("th"), F.lit(2**40)))),
        "neardup-nodes",
    )
    fps = stage(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "neardup-fps")
    total = nodes.count()
    near = components(simhash.linked(fps.select("fp")), "neardup-simhash")
    linked = near.select(F.col("node").alias("fp"), F.col("root"))
    roots = fps.select(F.col("fp").alias("root"), F.col("first").alias("to"))
    of_fp = linked.join(roots, "root").join(fps, "fp").select(F.col("to").alias("a"), F.col("first").alias("b"))
    same = hot_join(nodes.select("node", "fp"), fps, "fp", "n", total)
    of_node = same.select(F.col("first").alias("a"), F.col("node").alias("b"))
    edges = of_fp.unionByName(of_node).filter(F.col("a") != F.col("b"))

    def propose(around: DataFrame) -> DataFrame:
        wanted = around.select(F.explode(F.array("centre", "node")).alias("node")).distinct()
        return _proposed(around, _grams(wanted, nodes, rows, repeated), similarity)

    every = _joined(nodes, edges, lambda pairs: _verified(pairs, nodes, rows, similarity, repeated), propose)
    tied = every.filter(F.col("node") != F.col("root"))
    return nodes.join(tied, "node", "left_anti").select("doc_id", "th")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest ``doc_id``."""
    kept = stage(survivors(docs, similarity), "neardup-kept").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th")
    )
    wrapped = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.col("row.doc_id").cast("long").alias("_doc"),
        F.md5(F.coalesce("row.text", F.lit(""))).alias("_key"),
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_th"))
    found = wrapped.join(kept, same, "left_semi")
    repeats = wrapped.groupBy("_doc", "_key").count().filter("count > 1").limit(1).count()
    if repeats:
        found = found.dropDuplicates(["_doc", "_key"])
    return found.select("row.*")
