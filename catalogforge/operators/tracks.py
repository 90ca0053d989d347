"""Compiled rows to typed tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge import functions as C
from catalogforge.functions.text import UNKNOWN_ALBUM, UNKNOWN_ARTIST
from catalogforge.operators.ordering import dense_sequence
from catalogforge.sources.schema import TRACK_COLUMNS

# Fixed value: tracks per chunk document.
CHUNK_SIZE = 1000

# Generated methods beyond so many bytes stay uncompiled in the JVM, where the session does not say
# otherwise than Spark's default.
METHOD_KEY, METHOD_DEFAULT, METHOD = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"

# Compiled columns read as whole numbers, those kept only above zero, and texts.
POSITIVE = {
    "Bit Rate": "bitRate",
    "Sample Rate": "sampleRate",
    "Track Number": "trackNumber",
    "Track Count": "trackCount",
    "Disc Number": "discNumber",
    "Disc Count": "discCount",
}
NUMBERS = ("Year", "Size", "Time", "My Rating", "Volume Adjustment", *POSITIVE)
TEXTS = {
    "Composer": "composer",
    "Grouping": "grouping",
    "Last Played": "lastPlayed",
    "Date Added": "dateAdded",
    "Date Modified": "dateModified",
    "Location": "location",
    "Kind": "kind",
    "Equalizer": "equalizer",
    "Comments": "comments",
}


def small_methods(df: DataFrame) -> None:
    """Lets the session run projections that are too wide to be compiled as one method in parts."""
    if df.sparkSession.conf.get(METHOD_KEY) == METHOD_DEFAULT:
        df.sparkSession.conf.set(METHOD_KEY, METHOD)


def clean_tracks(
    compiled: DataFrame, order: str = "seq", max_year: int | Column | None = None
) -> DataFrame:
    """Typed, cleaned tracks, not yet numbered; ``order`` is carried along.

    Rows without a track name are dropped, and so are rows whose artist or album is
    all question marks. Missing artists and albums get a default name first.
    """
    small_methods(compiled)
    artist, album = C.clean_artist("Artist"), C.clean_album("Album")
    named = compiled.filter(
        ~C.is_blank("Name") & _not_questioned("Artist", artist) & _not_questioned("Album", album)
    )
    text, number = C.blank_to_null, C.lenient_int
    # Values used more than once are computed here, once.
    once = named.select(
        C.strip("Name").alias("name"),
        C.or_default(artist, UNKNOWN_ARTIST).alias("artist"),
        C.or_default(album, UNKNOWN_ALBUM).alias("album"),
        C.clean_genre("Genre").alias("genre"),
        *[number(column).alias(f"_{column}") for column in NUMBERS],
        *[text(column).alias(name) for column, name in TEXTS.items()],
        F.col(order).alias("seq"),
    )
    seen = {name: C.positive(f"_{column}") for column, name in POSITIVE.items()}
    return once.withColumns(
        {
            "artistSlug": C.slug("artist"),
            "albumSlug": C.slug("album"),
            "year": C.year_in_range("_Year", max_year),
            "size": F.col("_Size"),
            "duration": F.col("_Time"),
            "durationFormatted": C.minutes_seconds("_Time"),
            **seen,
            "rating": F.col("_My Rating"),
            "volumeAdjustment": C.nonzero("_Volume Adjustment"),
        }
    ).select(*[c for c in TRACK_COLUMNS if c != "id"], "seq")


def _not_questioned(raw: str, cleaned: Column) -> Column:
    """Not all question marks. Only values with one in them are cleaned to find out;
    a name that is missing gets a default later and so counts as valid."""
    questioned = F.coalesce(F.contains(F.col(raw), F.lit("?")), F.lit(False))
    return F.when(questioned, C.is_valid_name(cleaned) | (cleaned == "")).otherwise(True)


def with_track_ids(tracks: DataFrame) -> DataFrame:
    """Replace ``seq`` by the dense 0-based number of the track and derive its ``id``."""
    numbered = dense_sequence(tracks, "seq", "_number")
    track_id = F.concat(F.lit("track-"), C.padded("_number", 5))
    return numbered.withColumn("id", track_id).select(
        *TRACK_COLUMNS, F.col("_number").alias("seq")
    )


def build_tracks(
    compiled: DataFrame, order: str = "seq", max_year: int | Column | None = None
) -> DataFrame:
    """The track table: 28 typed columns, and ``seq``, dense from 0 in ``order``."""
    return with_track_ids(clean_tracks(compiled, order, max_year))


def with_chunks(tracks: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Add the 1-based ``chunk`` of each numbered track."""
    return tracks.withColumn("chunk", (F.floor(F.col("seq") / size) + 1).cast("int"))


def chunk_documents(tracks: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """One document per chunk of at most ``size`` tracks, tracks in order.

    ``totalChunks`` comes from the highest track number, as a scalar subquery.
    """
    row = F.struct("seq", F.struct(*TRACK_COLUMNS).alias("track"))
    chunks = (
        with_chunks(tracks, size)
        .groupBy("chunk")
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
    )
    last = tracks.agg((F.floor(F.max("seq") / size) + 1).cast("int").alias("totalChunks"))
    return chunks.select(
        "chunk",
        last.scalar().alias("totalChunks"),
        F.size("rows").alias("count"),
        F.transform("rows", lambda r: r["track"]).alias("tracks"),
    )


def tracks_of_chunks(documents: DataFrame) -> DataFrame:
    """Tracks read back from chunk documents, with the chunk they came in."""
    return documents.select("chunk", F.inline("tracks"))


def extract_tracks(compiled: DataFrame, order: str = "seq") -> DataFrame:
    """``track, artist, album`` of rows that have all three.

    Unlike the track table this drops rows without artist or album instead of naming
    them, and leaves quotes around album names.
    """
    artist, album = C.clean_artist("Artist"), C.strip("Album")
    return compiled.filter(
        ~C.is_blank("Name") & C.is_valid_name(artist) & C.is_valid_name(album)
    ).select(
        C.strip("Name").alias("track"),
        artist.alias("artist"),
        album.alias("album"),
        F.col(order).alias("seq"),
    )

