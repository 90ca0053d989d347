"""Column functions; every one takes a column or its name and returns a Column."""

from catalogforge.functions.numbers import (
    clean_year,
    gigabytes,
    hours,
    hours_minutes,
    lenient_int,
    minutes_seconds,
    nonzero,
    padded,
    positive,
    rounded,
    whole_days,
    whole_minutes,
    with_thousands,
    year_in_range,
    year_or_dash,
)
from catalogforge.functions.text import (
    ascii_slug,
    blank_to_null,
    clean_album,
    clean_artist,
    clean_genre,
    decode_lines,
    first_letter,
    front_article,
    is_blank,
    is_valid_name,
    letter_or_hash,
    link,
    natural_order,
    or_default,
    slug,
    split_tabs,
    strip,
    strip_end,
    strip_quotes,
    strip_start,
)

__all__ = [
    "ascii_slug",
    "blank_to_null",
    "clean_album",
    "clean_artist",
    "clean_genre",
    "clean_year",
    "decode_lines",
    "first_letter",
    "front_article",
    "gigabytes",
    "hours",
    "hours_minutes",
    "is_blank",
    "is_valid_name",
    "lenient_int",
    "letter_or_hash",
    "link",
    "minutes_seconds",
    "natural_order",
    "nonzero",
    "or_default",
    "padded",
    "positive",
    "rounded",
    "slug",
    "split_tabs",
    "strip",
    "strip_end",
    "strip_quotes",
    "strip_start",
    "whole_days",
    "whole_minutes",
    "with_thousands",
    "year_in_range",
    "year_or_dash",
]
