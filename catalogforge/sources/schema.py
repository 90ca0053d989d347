"""Fixed column lists of the exports and of the tables made from them."""

from __future__ import annotations

# The columns of a compiled row, in order. Files without a header are
# read by position under this list.
COLUMNS = (
    "Name", "Artist", "Composer", "Album", "Grouping", "Genre", "Size", "Time",
    "Disc Number", "Disc Count", "Track Number", "Track Count", "Year",
    "Date Modified", "Date", "Date Added", "Bit Rate", "Sample Rate",
    "Volume Adjustment", "Kind", "Equalizer", "Comments", "Play Count",
    "Last Played", "My Rating", "Location",
)

# A first line is a header when enough of its first fields are in here.
HEADER_WORDS = (
    "Name", "Artist", "Composer", "Album", "Genre", "Size", "Time",
    "Track Number", "Year", "Date", "Location",
)
HEADER_FIELDS_LOOKED_AT = 15
HEADER_WORDS_NEEDED = 5
LAST_HEADER = "Location"
MAX_GUESSED_HEADERS = 27
INLINE_DATA_MARGIN = 5

# Real column lists of header-less files, by their number of fields
# (the last field is an unnamed volume number). Used by ``layout="by_width"``.
COLUMNS_BY_WIDTH = {
    19: (
        "Name", "Artist", "Album", "Genre", "Size", "Time", "Track Number",
        "Track Count", "Year", "Date", "Date Added", "Bit Rate", "Sample Rate",
        "Volume Adjustment", "Kind", "Equalizer", "Comments", "Location",
    ),
    25: (
        "Name", "Artist", "Composer", "Album", "Genre", "Size", "Time",
        "Disc Number", "Disc Count", "Track Number", "Track Count", "Year",
        "Date Modified", "Date Added", "Bit Rate", "Sample Rate",
        "Volume Adjustment", "Kind", "Equalizer", "Comments", "Play Count",
        "Last Played", "My Rating", "Location",
    ),
    26: (
        "Name", "Artist", "Composer", "Album", "Grouping", "Genre", "Size", "Time",
        "Disc Number", "Disc Count", "Track Number", "Track Count", "Year",
        "Date Modified", "Date Added", "Bit Rate", "Sample Rate",
        "Volume Adjustment", "Kind", "Equalizer", "Comments", "Play Count",
        "Last Played", "My Rating", "Location",
    ),
}

# Columns every compiled row carries beside its content.
SOURCE_FILE = "_source_file"
LINE_NUMBER = "_line_number"
LINEAGE = (SOURCE_FILE, LINE_NUMBER)
EXTRA = "extra"
EXTRA_TYPE = "array<struct<name:string,value:string>>"
CONTENT = (*COLUMNS, EXTRA)

# First-line layouts.
INLINE_HEADER = "header+data"
SEPARATE_HEADER = "separate_header"
NO_HEADER = "no_header"

TRACK_SCHEMA = """
    id string, name string, artist string, artistSlug string, composer string,
    album string, albumSlug string, grouping string, genre string, year int,
    size bigint, duration bigint, durationFormatted string, bitRate bigint,
    sampleRate bigint, trackNumber bigint, trackCount bigint, discNumber bigint,
    discCount bigint, lastPlayed string, rating bigint, dateAdded string,
    dateModified string, location string, kind string, volumeAdjustment bigint,
    equalizer string, comments string
"""
TRACK_COLUMNS = tuple(f.split()[0] for f in TRACK_SCHEMA.split(","))

CHUNK_SCHEMA = f"chunk int, totalChunks int, count int, tracks array<struct<{TRACK_SCHEMA.strip()}>>"
