"""Turning export lines into rows of one schema, each under its own file's header.

The text is scanned three times: for the sizes of segments and for their first lines,
which are small and staged, and to parse. The data itself is never shuffled;
rows meet their file's layout in a join on (source, segment), so no join key stands
for more than one bounded segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogforge.functions import is_blank, split_tabs, strip, strip_end, strip_start
from catalogforge.operators.ordering import global_positions
from catalogforge.session import stage
from catalogforge.sources.schema import (
    COLUMNS,
    COLUMNS_BY_WIDTH,
    EXTRA,
    EXTRA_TYPE,
    HEADER_FIELDS_LOOKED_AT,
    HEADER_WORDS,
    HEADER_WORDS_NEEDED,
    INLINE_DATA_MARGIN,
    INLINE_HEADER,
    LAST_HEADER,
    LINE_NUMBER,
    LINEAGE,
    MAX_GUESSED_HEADERS,
    NO_HEADER,
    SEPARATE_HEADER,
    SOURCE_FILE,
)

# ``seq`` is the segment's rank over the bits of an offset: one integer in (path, line)
# order. How many bits an offset takes follows the longest segment, so ranks have the rest.
SEQ_BITS = 63


def header_field_count(fields: Column) -> Column:
    """Number of header fields on a first line, 0 if it is not a header."""
    looked_at = F.slice(fields, 1, HEADER_FIELDS_LOOKED_AT)
    known = F.size(F.filter(looked_at, lambda f: f.isin(list(HEADER_WORDS))))
    last = F.array_position(fields, LAST_HEADER).cast("int")
    guessed = F.least(F.lit(MAX_GUESSED_HEADERS), F.floor(F.size(fields) / 2).cast("int"))
    return F.when(known < HEADER_WORDS_NEEDED, 0).when(last > 0, last).otherwise(guessed)


def first_line_format(fields: Column, header_fields: Column) -> Column:
    return (
        F.when(header_fields == 0, NO_HEADER)
        .when(F.size(fields) > header_fields + INLINE_DATA_MARGIN, INLINE_HEADER)
        .otherwise(SEPARATE_HEADER)
    )


def _names(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _file_header(fields: Column, header_fields: Column, layout: str) -> Column:
    """Column names of a file: its own header, or a fixed list if it has none."""
    fixed = _names(COLUMNS)
    if layout == "by_width":
        for width, names in COLUMNS_BY_WIDTH.items():
            fixed = F.when(F.size(fields) == width, _names(names)).otherwise(fixed)
    elif layout != "positional":
        raise ValueError(f"layout must be 'positional' or 'by_width', not {layout!r}")
    return F.when(header_fields > 0, F.slice(fields, 1, header_fields)).otherwise(fixed)


def _last_index(header: Column, name: Column | str) -> Column:
    """0-based index of the last column of that name, -1 if there is none."""
    place = F.array_position(F.reverse(header), name).cast("int")
    return F.when(place > 0, F.size(header) - place).otherwise(-1)


def measure_segments(lines: DataFrame) -> DataFrame:
    """One staged row per segment: size, first lines, and rank in (path, line) order.

    Sizes are fixed-width aggregates, which are hashed; the first lines are then looked up by
    their place. Carrying lines in the aggregate would make every task sort all its text.
    """
    filled = F.when(~is_blank("line"), F.col("pos"))
    sizes = lines.groupBy("source_path", "source_file", "segment").agg(
        F.min("pos").alias("first_pos"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count(filled).alias("n_filled"),
        F.min(filled).alias("first_filled"),
        F.max(filled).alias("last_filled"),
    )
    sizes = stage(sizes, "segments")
    places = F.array_compact(F.array_distinct(F.array("first_pos", "first_filled")))
    wanted = sizes.select("source_path", "segment", F.explode(places).alias("pos"))
    found = lines.select("source_path", "segment", "pos", "line").join(
        wanted, ["source_path", "segment", "pos"]
    )
    first_lines = found.groupBy("source_path", "segment").agg(
        F.min_by("line", "pos").alias("top_line"), F.max_by("line", "pos").alias("_later_line")
    )
    first_line = F.when(F.col("first_filled").isNotNull(), F.col("_later_line"))
    facts = (
        sizes.join(stage(first_lines, "first-lines"), ["source_path", "segment"], "left")
        .withColumn("first_line", first_line)
        .drop("_later_line")
    )
    # Paths sort part by part, so a folder comes before its longer-named siblings.
    by_path = [F.split("source_path", "/"), "segment"]
    return global_positions(facts, by_path, "rank")


def offset_bits(longest: int, last_rank: int) -> int:
    """Bits of ``seq`` for offsets in segments of up to ``longest`` lines; fails where ranks
    up to ``last_rank`` do not fit above them."""
    bits = max(1, int(longest).bit_length())
    if bits + int(last_rank).bit_length() > SEQ_BITS:
        raise ValueError(
            f"{last_rank} segments of up to {longest} lines exceed the order key; read larger splits"
        )
    return bits


def _numbered(segments: DataFrame) -> DataFrame:
    """Add ``before``: the lines of the same source in earlier segments."""
    earlier = (
        Window.partitionBy("source_path")
        .orderBy("segment")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return segments.withColumn(
        "before", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)) - F.col("first_pos") + 1
    )


def describe_sources(segments: DataFrame, layout: str = "positional") -> DataFrame:
    """One row per source: its format as reported, its header, and its row count."""
    files = (
        _numbered(segments)
        .groupBy("source_path", "source_file")
        .agg(
            F.min("rank").alias("rank"),
            F.sum("n_filled").alias("n_filled"),
            F.min(F.col("before") + F.col("first_filled")).alias("first_no"),
            F.max(F.col("before") + F.col("last_filled")).alias("last_no"),
            F.min_by("top_line", "segment").alias("top_line"),
            F.min_by("first_line", F.when(F.col("n_filled") > 0, F.col("segment"))).alias(
                "first_line"
            ),
        )
    )
    # The report looks at the physical first line; parsing at the first filled one,
    # cut at its end only where it is also the last.
    top = split_tabs(strip("top_line"))
    start = strip_start(F.coalesce("first_line", F.lit("")))
    parsed = F.when(F.col("first_no") == F.col("last_no"), strip_end(start)).otherwise(start)
    return (
        files.withColumn("_top", top)
        .withColumn("_fields", split_tabs(parsed))
        .withColumn("header_fields", header_field_count(F.col("_fields")))
        .withColumn("parse_format", first_line_format(F.col("_fields"), F.col("header_fields")))
        .select(
            "source_path",
            "source_file",
            "rank",
            first_line_format(F.col("_top"), header_field_count(F.col("_top"))).alias("format"),
            F.size("_top").alias("field_count"),
            "parse_format",
            "header_fields",
            _file_header(F.col("_fields"), F.col("header_fields"), layout).alias("header"),
            "first_no",
            "last_no",
            (
                F.col("n_filled")
                - F.when(F.col("parse_format") == SEPARATE_HEADER, 1).otherwise(0)
            ).alias("n_rows"),
        )
    )


def unified_header(sources: DataFrame) -> DataFrame:
    """``ordinal, field``: every column of the compiled table, in order.

    Known columns that occur come first in their fixed order, then unknown ones by
    name, then lineage. Only sources with rows count.
    """
    found = (
        sources.filter(F.col("n_rows") > 0)
        .select(F.explode("header").alias("field"))
        .distinct()
        .filter(~F.col("field").isin(list(LINEAGE)))
    )
    lineage = sources.sparkSession.createDataFrame([(n,) for n in LINEAGE], "field string")
    place = F.array_position(_names(COLUMNS), F.col("field"))
    known = found.withColumn(
        "_key", F.when(place > 0, place).otherwise(F.lit(len(COLUMNS) + 1))
    ).union(
        lineage.withColumn(
            "_key", F.lit(len(COLUMNS) + 1) + F.array_position(_names(LINEAGE), F.col("field"))
        )
    )
    return global_positions(known, ["_key", "field"], "ordinal").select("ordinal", "field")


@dataclass(frozen=True)
class ParsedExports:
    """``rows`` (lazy), and what is known of their segments (written) and sources."""

    rows: DataFrame
    segments: DataFrame
    sources: DataFrame
    offset_bits: int

    def lineage_of(self, keyed: DataFrame) -> DataFrame:
        """Add path, file and line number to rows known by ``seq`` alone."""
        # Written, so that the planner knows its size when it picks the join.
        segments = stage(
            _numbered(self.segments)
            .join(self.sources.select("source_path", "first_no"), "source_path")
            .select(
                "rank",
                "source_path",
                F.col("source_file").alias(SOURCE_FILE),
                (F.col("before") + F.col("first_pos") - F.col("first_no") + 1).alias("_start"),
            ),
            "lineage",
        )
        offset = F.col("seq").bitwiseAND((1 << self.offset_bits) - 1)
        return (
            keyed.withColumn("rank", F.shiftright("seq", self.offset_bits))
            .join(segments, "rank")
            .withColumn(LINE_NUMBER, F.col("_start") + offset)
            .drop("rank", "_start")
        )


def parse_lines(lines: DataFrame, layout: str = "positional") -> ParsedExports:
    """Parse lines of any mix of layouts into one row per data line.

    Missing fields are empty, surplus fields dropped. ``rows`` has the known columns,
    ``extra`` for the filled columns no list knows, lineage, and ``seq``, the order
    of (path, line). ``layout="by_width"`` picks the column list of header-less
    files by their number of fields; ``"positional"`` always takes the default list.
    """
    segments = measure_segments(lines)
    sources = describe_sources(segments, layout)
    longest, last_rank = segments.agg(F.max("n_lines"), F.max("rank")).first()
    bits = offset_bits(longest or 0, last_rank or 0)

    # Everything a line needs to know about its file, one row per segment.
    header = F.col("header")
    unknown = F.array_sort(
        F.array_distinct(
            F.filter(header, lambda n: ~n.isin(list(COLUMNS + LINEAGE)))
        )
    )
    keys = stage(
        _numbered(segments)
        .join(
            sources.select(
                "source_path",
                "parse_format",
                "header_fields",
                "first_no",
                "last_no",
                F.transform(_names(COLUMNS), lambda n: _last_index(header, n)).alias("at"),
                F.transform(
                    unknown,
                    lambda n: F.struct(n.alias("name"), _last_index(header, n).alias("at")),
                ).alias("unknown"),
            ),
            "source_path",
        )
        .select(
            "source_path",
            "segment",
            "parse_format",
            "header_fields",
            "at",
            "unknown",
            (F.col("before") - F.col("first_no") + 1).alias("to_line_no"),
            (F.col("last_no") - F.col("first_no") + 1).alias("last_line_no"),
            F.shiftleft("rank", bits).alias("first_seq"),
            "first_pos",
            "n_lines",
        ),
        "layouts",
    )

    # A line outside its measured segment means the input changed between the scans.
    offset = F.col("pos") - F.col("first_pos")
    seq = F.when(offset.between(0, F.col("n_lines") - 1), F.col("first_seq") + offset).otherwise(
        F.raise_error("lines changed while they were being parsed").cast("bigint")
    )
    line_no = F.col("pos") + F.col("to_line_no")
    text = F.when(F.col(LINE_NUMBER) == 1, strip_start("line")).otherwise(F.col("line"))
    text = F.when(F.col(LINE_NUMBER) == F.col("last_line_no"), strip_end(text)).otherwise(text)
    first = F.col(LINE_NUMBER) == 1
    skip = F.col("header_fields")
    data = F.when(
        first & (F.col("parse_format") == INLINE_HEADER),
        F.slice(F.col("_all"), skip + 1, F.greatest(F.size("_all") - skip, F.lit(0))),
    ).otherwise(F.col("_all"))
    fields = [
        F.coalesce(F.get("_fields", F.get("at", F.lit(i))), F.lit("")).alias(name)
        for i, name in enumerate(COLUMNS)
    ]
    extra = F.filter(
        F.transform(
            "unknown",
            lambda u: F.struct(
                u["name"].alias("name"),
                F.coalesce(F.get("_fields", u["at"]), F.lit("")).alias("value"),
            ),
        ),
        lambda v: v["value"] != "",
    )
    rows = (
        lines.filter(~is_blank("line"))
        .join(keys, ["source_path", "segment"], "left")
        .withColumn("seq", seq)
        .withColumn(LINE_NUMBER, line_no)
        .filter(F.coalesce(~(first & (F.col("parse_format") == SEPARATE_HEADER)), F.lit(True)))
        .withColumn("_all", split_tabs(text))
        .withColumn("_fields", data)
        .select(
            *fields,
            extra.cast(EXTRA_TYPE).alias(EXTRA),
            F.col("source_file").alias(SOURCE_FILE),
            F.col(LINE_NUMBER),
            "seq",
            "source_path",
        )
    )
    return ParsedExports(rows, segments, sources, bits)
