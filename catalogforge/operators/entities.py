"""Indexes of artists and albums, facets and collection totals.

An entity is a slug; its members are the distinct names of the other kind (albums of
an artist, artists of an album). One slug may hold a third of all rows, so members
are kept as rows with a position; arrays are only ever built in bounded parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge import functions as C
from catalogforge.operators.ordering import first_per_group, global_positions, group_positions

MEMBERS_PER_PART = 1000
# Facet values and names shown in previews.
CLOUD_SIZE = 50
NAMES_SHOWN = 2
SAMPLE_SIZE = 10
SAMPLE_MEMBERS = 3
# A sketch has 2 ** this places.
SKETCH_BITS = 14


def entity_state(tracks: DataFrame, slug: str, name: str, member: str, order: str = "seq") -> DataFrame:
    """``slug, name, member, n, first, last``: what later rows can be added to."""
    return tracks.groupBy(slug, name, member).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last")
    )


def merged_states(states: DataFrame, slug: str, name: str, member: str) -> DataFrame:
    """States of several sets of rows as one state of all of them."""
    return states.groupBy(slug, name, member).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )


def entity_summary(
    tracks: DataFrame, slug: str, name: str, member: str, member_count: str, order: str = "seq"
) -> DataFrame:
    """``slug, name, <member_count>, trackCount, first_seq``, one row per slug.

    The name is the one seen last in ``order``. Rows first collapse to one per
    (slug, name, member) with fixed-width aggregates, then to one per member, then
    to one per slug; every step combines inside tasks before it shuffles.
    """
    return summary_of_states(entity_state(tracks, slug, name, member, order), slug, name, member, member_count)


def summary_of_states(states: DataFrame, slug: str, name: str, member: str, member_count: str) -> DataFrame:
    """``entity_summary`` from states, merged or not."""
    per_member = states.groupBy(slug, member).agg(
        F.sum("n").alias("n"),
        F.min("first").alias("first"),
        F.max_by(F.struct("last", name), "last").alias("named"),
    )
    return per_member.groupBy(F.col(slug).alias("slug")).agg(
        F.max_by(F.col(f"named.{name}"), F.col("named.last")).alias("name"),
        F.count(F.lit(1)).alias(member_count),
        F.sum("n").alias("trackCount"),
        F.min("first").alias("first_seq"),
    )


def entity_index(
    tracks: DataFrame, slug: str, name: str, member: str, member_count: str, order: str = "seq"
) -> DataFrame:
    """``entity_summary`` with each row's place by lower-cased name."""
    return numbered_summary(entity_summary(tracks, slug, name, member, member_count, order))


def numbered_summary(summary: DataFrame) -> DataFrame:
    return global_positions(summary, [F.lower("name"), "first_seq"]).drop("first_seq")


def artist_index(tracks: DataFrame) -> DataFrame:
    return entity_index(tracks, "artistSlug", "artist", "album", "albumCount")


def album_index(tracks: DataFrame) -> DataFrame:
    return entity_index(tracks, "albumSlug", "album", "artist", "artistCount")


def entity_members(tracks: DataFrame, slug: str, member: str) -> DataFrame:
    """``slug, <member>, position``: distinct members in code-point order."""
    pairs = tracks.select(F.col(slug).alias("slug"), member).distinct()
    return group_positions(pairs, ["slug"], [member])


def entity_documents(
    index: DataFrame, members: DataFrame, member: str, plural: str, part_size: int = MEMBERS_PER_PART
) -> DataFrame:
    """Index rows with their member arrays, at most ``part_size`` names per row.

    An entity with more members continues in rows of the same slug with the next
    ``part``; no row or task ever holds all names of a hot entity.
    """
    parts = (
        members.withColumn("part", (F.floor((F.col("position") - 1) / part_size) + 1).cast("int"))
        .groupBy("slug", "part")
        .agg(F.array_sort(F.collect_list(member)).alias(plural))
    )
    return index.join(parts, "slug")


def facet_values(tracks: DataFrame, column: str) -> DataFrame:
    """``<column>, position``: the distinct non-null values in order."""
    values = tracks.select(column).filter(F.col(column).isNotNull()).distinct()
    return global_positions(values, [column])


def _distinct(tracks: DataFrame, slug: str) -> DataFrame:
    """How many values a column has, nulls left out: distinct in every task, then in all."""
    return tracks.select(slug).filter(F.col(slug).isNotNull()).distinct().agg(F.count(F.lit(1)))


def distinct_slugs(tracks: DataFrame) -> DataFrame:
    """``totalArtists, totalAlbums`` in one row."""
    one = tracks.agg(F.lit(1).alias("one"))
    return one.select(
        _distinct(tracks, "artistSlug").scalar().alias("totalArtists"),
        _distinct(tracks, "albumSlug").scalar().alias("totalAlbums"),
    )


def slug_sketches(tracks: DataFrame) -> DataFrame:
    """One row of HLL sketches, to be stored with a run and merged with those of others."""
    return tracks.agg(
        F.hll_sketch_agg("artistSlug", SKETCH_BITS).alias("artists"),
        F.hll_sketch_agg("albumSlug", SKETCH_BITS).alias("albums"),
    )


def merged_sketches(parts: Sequence[DataFrame]) -> DataFrame:
    """The sketches of all parts together."""
    return reduce(DataFrame.unionByName, parts).agg(
        F.hll_union_agg("artists").alias("artists"), F.hll_union_agg("albums").alias("albums")
    )


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """``totalArtists, totalAlbums`` as estimated; their standard error is below one in a hundred."""
    return sketches.select(
        F.hll_sketch_estimate("artists").alias("totalArtists"),
        F.hll_sketch_estimate("albums").alias("totalAlbums"),
    )


def collection_stats(tracks: DataFrame) -> DataFrame:
    """One row of totals over the track table.

    Each distinct count is a scan of its own column, so no row is expanded for the two.
    """
    return stats_of_states(totals_state(tracks), tracks, tracks)


def totals_state(tracks: DataFrame) -> DataFrame:
    """``n, sizes, durations, bitRates, bitRated, rated``: one row that others can be added to."""
    return tracks.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("sizes"),
        F.sum("duration").alias("durations"),
        F.sum(F.col("bitRate").cast("double")).alias("bitRates"),
        F.count("bitRate").alias("bitRated"),
        F.count_if(F.col("rating") > 0).alias("rated"),
    )


def stats_of_states(totals: DataFrame, artists: DataFrame, albums: DataFrame) -> DataFrame:
    """``collection_stats`` from rows of ``totals_state`` and tables that hold every slug."""
    bit_rate = F.when(F.sum("bitRated") > 0, F.sum("bitRates") / F.sum("bitRated")).otherwise(0.0)
    totals = totals.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("totalTracks"),
        F.coalesce(F.sum("sizes"), F.lit(0)).alias("totalSizeBytes"),
        F.coalesce(F.sum("durations"), F.lit(0)).alias("totalDurationSeconds"),
        C.rounded(bit_rate, 1).alias("avgBitRate"),
        F.coalesce(F.sum("rated"), F.lit(0)).alias("tracksWithRating"),
    )
    size, seconds = F.col("totalSizeBytes"), F.col("totalDurationSeconds")
    return totals.select(
        "totalTracks",
        _distinct(artists, "artistSlug").scalar().alias("totalArtists"),
        _distinct(albums, "albumSlug").scalar().alias("totalAlbums"),
        "totalSizeBytes",
        C.gigabytes(size).alias("totalSizeGB"),
        "totalDurationSeconds",
        C.hours(seconds).alias("totalDurationHours"),
        C.hours_minutes(seconds).alias("totalDurationFormatted"),
        "avgBitRate",
        "tracksWithRating",
    )


def metadata_document(
    stats: DataFrame, genres: DataFrame, years: DataFrame, part_size: int = MEMBERS_PER_PART
) -> DataFrame:
    """The metadata document: totals, facet lists, nested ``stats``.

    Years are bounded by their range. Genres are free text, so their list continues in
    further parts, each of which repeats the rest.
    """
    of_part = (F.floor((F.col("position") - 1) / part_size) + 1).cast("int")
    lists = (
        genres.groupBy(of_part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("position", "genre"))).alias("_pairs"))
        .select("part", F.transform("_pairs", lambda p: p["genre"]).alias("genres"))
    )
    last = F.coalesce(genres.agg(F.max(of_part)).scalar(), F.lit(1))
    pairs = F.array_sort(F.collect_list(F.struct("position", "year")))
    all_years = years.agg(F.transform(pairs, lambda p: p["year"]).alias("years")).scalar()
    parts = stats.withColumn("part", F.explode(F.sequence(F.lit(1), last)))
    return parts.join(lists, "part", "left").select(
        "part",
        "totalTracks",
        "totalArtists",
        "totalAlbums",
        F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
        all_years.alias("years"),
        F.struct(
            "totalSizeBytes",
            "totalSizeGB",
            "totalDurationSeconds",
            "totalDurationHours",
            "totalDurationFormatted",
            "avgBitRate",
            "tracksWithRating",
        ).alias("stats"),
    )


def _extract(pairs: DataFrame, entity: str, member: str) -> DataFrame:
    """Distinct pairs; an entity without any member keeps one row with a null."""
    members = pairs.filter(F.col(member) != "").distinct()
    alone = (
        pairs.groupBy(entity)
        .agg(F.bool_or(F.col(member) != "").alias("_any"))
        .filter(~F.col("_any"))
        .select(entity, F.lit(None).cast("string").alias(member))
    )
    return group_positions(members.unionByName(alone), [entity], [member])


def extract_artists(compiled: DataFrame) -> DataFrame:
    """``artist, album, position``: valid artists with their albums as written."""
    pairs = compiled.select(
        C.clean_artist("Artist").alias("artist"),
        F.coalesce(C.strip("Album"), F.lit("")).alias("album"),
    )
    return _extract(pairs.filter(C.is_valid_name("artist")), "artist", "album")


def extract_albums(compiled: DataFrame) -> DataFrame:
    """``album, artist, position``: valid albums with cleaned artists, valid or not."""
    pairs = compiled.select(
        C.clean_album("Album").alias("album"),
        F.coalesce(C.clean_artist("Artist"), F.lit("")).alias("artist"),
    )
    return _extract(pairs.filter(C.is_valid_name("album")), "album", "artist")


def extracted_documents(
    pairs: DataFrame, entity: str, member: str, plural: str, part_size: int = MEMBERS_PER_PART
) -> DataFrame:
    """Extracted pairs as rows with member arrays in parts; no member, empty array.

    ``number`` is the place of the entity in order, ``total`` the number of entities.
    """
    parts = (
        pairs.withColumn("part", (F.floor((F.col("position") - 1) / part_size) + 1).cast("int"))
        .groupBy(entity, "part")
        .agg(F.array_sort(F.collect_list(member)).alias(plural))
    )
    order = global_positions(pairs.select(entity).distinct(), [entity], "number")
    total = order.agg(F.count(F.lit(1))).scalar()
    return parts.join(order, entity).withColumn("total", total)


def preview(
    pairs: DataFrame, entity: Sequence[str], member: str, shown: int = NAMES_SHOWN, tail: str = " +"
) -> DataFrame:
    """The first members of each entity as text, and how many more there are."""
    n = pairs.groupBy(*entity).agg(F.count(member).alias("n"))
    head = (
        first_per_group(pairs.filter(F.col(member).isNotNull()), entity, [member], shown, "_place")
        .groupBy(*entity)
        .agg(F.array_join(F.array_sort(F.collect_list(member)), ", ").alias("head"))
    )
    more = F.when(F.col("n") > shown, F.concat(F.lit(tail), F.col("n") - shown, F.lit(" more")))
    text = F.concat(F.coalesce("head", F.lit("")), F.coalesce(more, F.lit("")))
    return n.join(head, list(entity), "left").select(*entity, "n", text.alias("preview"))


def sample_entities(pairs: DataFrame, entity: str, member: str) -> DataFrame:
    """The first ten entities, each with up to three members and a count of the rest."""
    first = pairs.select(entity).distinct().orderBy(entity).limit(SAMPLE_SIZE)
    few = pairs.join(first, entity, "left_semi")
    shown = preview(few, [entity], member, SAMPLE_MEMBERS, " ... (+")
    return shown.select(
        entity,
        "n",
        F.when(F.col("n") > SAMPLE_MEMBERS, F.concat("preview", F.lit(")")))
        .otherwise(F.col("preview"))
        .alias("preview"),
    )


def facet_cloud(facet: DataFrame, column: str, shown: int = CLOUD_SIZE) -> DataFrame:
    """The first ``shown`` values of a facet, each with the number left out."""
    total = facet.agg(F.count(F.lit(1)).alias("n")).scalar()
    return facet.filter(F.col("position") <= shown).withColumn(
        "more", F.greatest(total - shown, F.lit(0)).cast("bigint")
    )
