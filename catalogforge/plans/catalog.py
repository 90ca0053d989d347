"""Compiled table to catalogue: tracks, indexes, listings, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from catalogforge.operators import browse, entities, search, tracks
from catalogforge.sources import tables


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def build_catalogue(
    spark: SparkSession,
    compiled: DataFrame,
    out: str,
    order: str = "seq",
    max_year: int | Column | None = None,
) -> None:
    """Write the track table, everything derived from it, and the JSON documents.

    Tracks are written once and read back column by column for each product.
    """
    rows = _table(tracks.build_tracks(compiled, order, max_year), f"{out}/tracks")

    artists = _table(entities.artist_index(rows), f"{out}/artists")
    albums = _table(entities.album_index(rows), f"{out}/albums")
    artist_albums = _table(
        entities.entity_members(rows, "artistSlug", "album"), f"{out}/artist_members"
    )
    album_artists = _table(
        entities.entity_members(rows, "albumSlug", "artist"), f"{out}/album_members"
    )
    genres = _table(entities.facet_values(rows, "genre"), f"{out}/genres")
    years = _table(entities.facet_values(rows, "year"), f"{out}/years")
    stats = _table(entities.collection_stats(rows), f"{out}/stats")

    tables.write_chunks(tracks.chunk_documents(rows), f"{out}/json/chunks")
    tables.write_json(
        entities.entity_documents(artists, artist_albums, "album", "albums"),
        f"{out}/json/artists",
    )
    tables.write_json(
        entities.entity_documents(albums, album_artists, "artist", "artists"),
        f"{out}/json/albums",
    )
    tables.write_json(
        entities.metadata_document(stats, genres, years), f"{out}/json/metadata"
    )


def build_listings(spark: SparkSession, catalogue: str, out: str) -> None:
    """Write what the browsing pages show, from a catalogue's tables."""
    rows = spark.read.parquet(f"{catalogue}/tracks")
    artists = spark.read.parquet(f"{catalogue}/artists")
    albums = spark.read.parquet(f"{catalogue}/albums")
    album_artists = spark.read.parquet(f"{catalogue}/album_members")

    listings = {
        "artist_detail": browse.artist_detail(rows),
        "artist_albums": browse.artist_albums(rows),
        "artist_tracks": browse.artist_album_tracks(rows),
        "album_detail": browse.album_detail(rows),
        "album_tracks": browse.album_tracks(rows),
        "album_discs": browse.album_discs(rows),
        "artist_letters": browse.letter_index(artists, hash_others=False),
        "album_letters": browse.letter_index(albums, hash_others=True),
        "album_previews": entities.preview(
            album_artists.select("slug", "artist"), ["slug"], "artist"
        ),
        "dangling_links": browse.dangling_artist_links(album_artists, artists),
        "keywords": search.keyword_postings(rows, "id", "name"),
    }
    for name, listing in listings.items():
        listing.write.parquet(f"{out}/{name}")
    pages = _table(browse.paginate(rows, browse.site_order()), f"{out}/track_pages")
    browse.page_manifest(pages).write.parquet(f"{out}/page_manifest")


def extract_entities(compiled: DataFrame, out: str, order: str = "seq") -> None:
    """Write the de-duplicated artist, album and track lists as JSON."""
    artists = entities.extract_artists(compiled)
    tables.write_json(
        entities.extracted_documents(artists, "artist", "album", "albums"), f"{out}/artists"
    )
    albums = entities.extract_albums(compiled)
    tables.write_json(
        entities.extracted_documents(albums, "album", "artist", "artists"), f"{out}/albums"
    )
    tables.write_json(tracks.extract_tracks(compiled, order), f"{out}/tracks")
