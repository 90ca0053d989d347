"""Per-entity detail, letter listings and pages over the track table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge import functions as C
from catalogforge.functions.text import UNKNOWN_ALBUM, UNKNOWN_SLUG
from catalogforge.operators.ordering import global_positions, group_positions

# Fixed value: tracks per page.
PAGE_SIZE = 100

# Copies of the index side that the tracks of one slug spread over.
SALTS = 8


def disc_order() -> list[Column]:
    """Order of tracks on an album: disc, track, then order of arrival."""
    zero = F.lit(0)
    return [F.coalesce("discNumber", zero), F.coalesce("trackNumber", zero), F.col("seq")]


def entity_tracks(index: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """Every index row with its tracks; a row without any keeps one row of nulls.

    Every slug's tracks spread over ``SALTS`` copies of its index row, so a slug that
    holds a third of all tracks fills several tasks. Written as an inner join plus the
    rows left over, which lets adaptive execution split further.
    """
    columns = [*[F.col(c) for c in index.columns], *[F.col(c) for c in tracks.columns]]
    copies = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.struct(*tracks.columns)), F.lit(SALTS)).cast("int")
    salted = tracks.withColumn("_salt_of", salt)
    same = (F.col("slug") == F.col(key)) & (F.col("_salt") == F.col("_salt_of"))
    found = copies.join(salted, same).select(*columns)
    present = tracks.select(F.col(key).alias("slug")).distinct()
    alone = index.join(present, "slug", "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def tracks_of(tracks: DataFrame, key: str, slug: str) -> DataFrame:
    """Tracks of one artist or album."""
    return tracks.filter(F.col(key) == slug)


def artist_detail(tracks: DataFrame) -> DataFrame:
    """``artistSlug, trackCount, albumGroups, minutes``; albums counted by name."""
    per_album = tracks.groupBy("artistSlug", _album_name().alias("album")).agg(
        F.count(F.lit(1)).alias("n"), _seconds().alias("seconds")
    )
    return per_album.groupBy("artistSlug").agg(
        F.sum("n").alias("trackCount"),
        F.count(F.lit(1)).alias("albumGroups"),
        C.whole_minutes(F.sum("seconds")).alias("minutes"),
    )


def _album_name() -> Column:
    return C.or_default("album", UNKNOWN_ALBUM)


def _seconds() -> Column:
    return F.sum(F.coalesce("duration", F.lit(0)))


def artist_albums(tracks: DataFrame) -> DataFrame:
    """``artistSlug, album, albumSlug, trackCount, position``: albums of each artist,
    by name in natural order; the slug is that of the first track to arrive."""
    groups = tracks.groupBy("artistSlug", _album_name().alias("album")).agg(
        F.min_by(C.or_default("albumSlug", UNKNOWN_SLUG), "seq").alias("albumSlug"),
        F.count(F.lit(1)).alias("trackCount"),
        F.min("seq").alias("first_seq"),
    )
    order = [C.natural_order("album"), "first_seq"]
    return group_positions(groups, ["artistSlug"], order).drop("first_seq")


def artist_album_tracks(tracks: DataFrame) -> DataFrame:
    """Add each track's ``position`` within its artist's album."""
    named = tracks.withColumn("album", _album_name())
    return group_positions(named, ["artistSlug", "album"], disc_order())


def album_tracks(tracks: DataFrame) -> DataFrame:
    """Add each track's ``position`` on its album."""
    return group_positions(tracks, ["albumSlug"], disc_order())


def album_detail(tracks: DataFrame) -> DataFrame:
    """``albumSlug, trackCount, minutes, year``; the year is the first track's, and
    stays null if that track has none."""
    return tracks.groupBy("albumSlug").agg(
        F.count(F.lit(1)).alias("trackCount"),
        C.whole_minutes(_seconds()).alias("minutes"),
        F.min_by("year", F.struct(*disc_order())).alias("year"),
    )


def album_discs(tracks: DataFrame) -> DataFrame:
    """``albumSlug, disc, trackCount, disc_key, showHeading``.

    Tracks without a disc number belong to disc 1. Discs appear by ``disc_key``, and
    get headings only where the album has several.
    """
    number = F.coalesce("discNumber", F.lit(0))
    discs = tracks.groupBy(
        "albumSlug", F.coalesce(C.nonzero(number), F.lit(1)).alias("disc")
    ).agg(F.count(F.lit(1)).alias("trackCount"), F.min(number).alias("disc_key"))
    several = discs.groupBy("albumSlug").agg((F.count(F.lit(1)) > 1).alias("showHeading"))
    return discs.join(several, "albumSlug")


def letter_index(index: DataFrame, hash_others: bool) -> DataFrame:
    """``letter, slug, name, position``: index rows under their first letter.

    ``position`` is the place within the letter, by name in natural order. With
    ``hash_others`` everything outside A to Z is filed under ``#``.
    """
    letter = C.letter_or_hash("name") if hash_others else C.first_letter("name")
    filed = index.select(letter.alias("letter"), "slug", "name", F.col("position").alias("_place"))
    return group_positions(filed, ["letter"], [C.natural_order("name"), "_place"]).drop("_place")


def letters(filed: DataFrame, hash_last: bool) -> DataFrame:
    """``letter, entries, position``: the headings of a letter index, in order."""
    counted = filed.groupBy("letter").agg(F.count(F.lit(1)).alias("entries"))
    order: list[Column | str] = ["letter"]
    if hash_last:
        order = [F.col("letter") == "#", C.natural_order("letter"), "letter"]
    return global_positions(counted, order)


def natural_positions(index: DataFrame) -> DataFrame:
    """Replace ``position`` by the place in natural name order."""
    placed = index.withColumnRenamed("position", "_place")
    return global_positions(placed, [C.natural_order("name"), "_place"]).drop("_place")


def site_order() -> list[Column]:
    """Order of the all-tracks listing; discs do not count."""
    return [
        C.natural_order("artist"),
        C.natural_order("album"),
        F.coalesce("trackNumber", F.lit(0)),
        F.col("seq"),
    ]


def paginate(
    df: DataFrame, order: Sequence[Column | str], size: int = PAGE_SIZE
) -> DataFrame:
    """Add ``position`` in ``order`` and the 1-based ``page`` of ``size`` rows."""
    placed = global_positions(df, order)
    return placed.withColumn("page", F.floor((F.col("position") - 1) / size) + 1)


def page_manifest(pages: DataFrame) -> DataFrame:
    """``page, totalPages, totalTracks, startIdx, endIdx`` of paginated rows."""
    totals = pages.agg(F.max("page").alias("p"), F.count(F.lit(1)).alias("n"))
    return pages.groupBy("page").agg(
        F.min("position").alias("startIdx"), F.max("position").alias("endIdx")
    ).select(
        "page",
        totals.select("p").scalar().alias("totalPages"),
        totals.select("n").scalar().alias("totalTracks"),
        "startIdx",
        "endIdx",
    )


def track_rows(
    tracks: DataFrame, base: str = "/", show_artist: bool = True, show_album: bool = True
) -> DataFrame:
    """Listing rows with links; artist and album columns may be left out."""
    columns = [F.col("seq"), F.col("name")]
    if show_artist:
        artist_link = C.link(base, F.concat(F.lit("artists/"), "artistSlug"))
        columns += [F.col("artist"), artist_link.alias("artistLink")]
    if show_album:
        album_link = C.link(base, F.concat(F.lit("albums/"), "albumSlug"))
        columns += [F.col("album"), album_link.alias("albumLink")]
    columns += [C.year_or_dash("year").alias("year"), F.col("durationFormatted").alias("duration")]
    return tracks.select(*columns)


def dangling_artist_links(members: DataFrame, artists: DataFrame) -> DataFrame:
    """Artist names on album pages whose ASCII slug leads to no artist page."""
    links = members.select("artist", C.ascii_slug("artist").alias("linkSlug")).distinct()
    known = artists.select(F.col("slug").alias("linkSlug"))
    return links.join(known, "linkSlug", "left_anti")
