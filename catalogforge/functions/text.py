"""Text cleaning as Column expressions. No UDFs; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when values are stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Trailing articles that move to the front of a name.
ARTICLES = ("The", "A", "An", "Le", "La", "Los", "Las", "El")

# Names given to rows that have none, and the slug of an empty text.
UNKNOWN_ARTIST = "Unknown Artist"
UNKNOWN_ALBUM = "Unknown Album"
UNKNOWN_SLUG = "unknown"

UNICODE_COLLATION = "UNICODE"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop white space of any kind at both ends (SQL ``trim`` drops blanks only)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def strip_start(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(WHITESPACE))


def strip_end(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def strip_quotes(c: Column | str) -> Column:
    """White space, then every double quote at either end, then white space again."""
    return strip(F.btrim(strip(c), F.lit('"')))


def front_article(c: Column | str) -> Column:
    """``Beatles, The`` -> ``The Beatles``; one article, matched in any case."""
    c = col(c)
    tail = F.lower(F.substring_index(c, ", ", -1))
    moved = F.concat(
        F.initcap(tail), F.lit(" "), F.left(c, F.length(c) - F.length(tail) - 2)
    )
    has_article = (F.instr(c, ", ") > 0) & tail.isin([a.lower() for a in ARTICLES])
    return F.when(has_article, moved).otherwise(c)


def clean_artist(c: Column | str) -> Column:
    return strip(front_article(strip_quotes(c)))


def clean_album(c: Column | str) -> Column:
    return strip_quotes(c)


def clean_genre(c: Column | str) -> Column:
    """Null unless an ASCII letter occurs, which rules out numbers and punctuation."""
    genre = strip_quotes(c)
    return F.when(genre.rlike("[A-Za-z]"), genre)


def is_valid_name(c: Column | str) -> Column:
    """Neither blank nor made of question marks alone."""
    return F.coalesce(F.btrim(strip(c), F.lit("?")) != "", F.lit(False))


def or_default(c: Column | str, default: str) -> Column:
    """``default`` where the value is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def slug(c: Column | str) -> Column:
    """Lower case, letters, digits and ``_`` of any script, words joined by ``-``."""
    kept = F.regexp_replace(F.lower(col(c)), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f-]", "")
    joined = F.regexp_replace(kept, r"(?U)[-\s\x1c-\x1f]+", "-")
    return or_default(F.btrim(joined, F.lit("-")), UNKNOWN_SLUG)


def ascii_slug(c: Column | str) -> Column:
    """The looser slug of artist links on album pages; edges keep their ``-``."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")


def first_letter(c: Column | str) -> Column:
    return F.upper(F.substring(col(c), 1, 1))


def letter_or_hash(c: Column | str) -> Column:
    """The first letter, or ``#`` for anything that is not A to Z."""
    letter = first_letter(c)
    return F.when(letter.rlike("[A-Z]"), letter).otherwise("#")


def natural_order(c: Column | str) -> Column:
    """A sort key in the root locale's order (accents and case weigh less than letters)."""
    return F.collate(col(c), UNICODE_COLLATION)


def split_tabs(c: Column | str) -> Column:
    """Fields of a tab-separated line, empty ones included."""
    return F.split(col(c), "\t", -1)


def decode_lines(c: Column | str) -> Column:
    """Lines of a whole text: bad bytes replaced, any line ending, outer space gone."""
    text = F.regexp_replace(F.make_valid_utf8(col(c)), "\r\n?", "\n")
    return F.split(strip(text), "\n", -1)


def link(base: str, path: Column | str) -> Column:
    """``base`` and ``path`` with exactly one ``/`` between them."""
    separator = "" if base.endswith("/") else "/"
    return F.concat(F.lit(base + separator), F.regexp_replace(col(path), "^/", ""))
