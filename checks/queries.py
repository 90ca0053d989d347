"""The registered queries: every operator, run over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogforge import functions as C
from catalogforge.operators import (
    browse,
    dedup,
    entities,
    incremental,
    inverted,
    lookup,
    maintained,
    numbered as numbering,
    parsing,
    report,
    search,
    tracks,
)
from catalogforge.operators.ordering import global_positions
from catalogforge.session import scratch_path, stage
from catalogforge.sources import exports, tables
from catalogforge.sources.schema import COLUMNS, CONTENT, EXTRA, LINEAGE
from checks.source import MAX_YEAR, catalog_src, export_lines, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Slug looked up, base of links, and words searched for.
LOOKUP = "nation_3"
BASE = "/music"
TERMS = ("The", "of", "la")
RANKED, PHRASE, PREFIX = ("with", "This", "from", "la"), ("of", "the"), "Tha"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Typed tracks under their original order key."""
    return tracks.clean_tracks(catalog_src(spark, sf), max_year=MAX_YEAR)


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.with_track_ids(cleaned(spark, sf))


def parsed(
    spark: SparkSession, sf: str, files: str = "mixed", layout: str = "positional"
) -> parsing.ParsedExports:
    lines = export_lines(spark, sf, files)
    return parsing.parse_lines(
        exports.lines_from_table(lines, "source_path", "line_no", "line"), layout
    )


def flat_extra() -> Column:
    """``extra`` as text, so that it compares as a plain value."""
    pairs = F.transform(EXTRA, lambda e: F.concat(e["name"], F.lit("="), e["value"]))
    return F.array_join(pairs, "|").alias(EXTRA)


def plain_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[F.col(f"`{c}`") for c in COLUMNS], flat_extra(), "source_path", *LINEAGE
    )


# --- sources and sinks -------------------------------------------------------------


def _write_exports(spark: SparkSession, sf: str) -> str:
    """The export lines as real text files, and a CSV beside them to be passed over."""
    path = scratch_path(spark, "exports")
    lines = export_lines(spark, sf).select(
        F.split_part("source_path", F.lit("/"), F.lit(2)).alias("nation"),
        F.split_part(F.substring_index("source_path", "/", -1), F.lit("."), F.lit(1)).alias("file"),
        "line_no",
        "line",
    )
    (
        lines.repartition("nation", "file")
        .sortWithinPartitions("nation", "file", "line_no")
        .drop("line_no")
        .write.partitionBy("nation", "file")
        .text(f"{path}/texts")
    )
    table(spark, sf, "nation").write.csv(f"{path}/other")
    return path


def _folder(name: str) -> Column:
    return F.regexp_extract("source_path", f"{name}=([^/]+)/", 1).alias(name)


@query
def s1_discover_exports(spark, sf):
    found = exports.discover_exports(spark, _write_exports(spark, sf))
    return found.groupBy(_folder("nation"), _folder("file")).agg(F.count(F.lit(1)).alias("files"))


@query
def s2_decode_lines(spark, sf):
    docs = table(spark, sf, "documents")
    return exports.lines_from_texts(docs, "doc_id", "text").select(
        F.col("source_path").cast("bigint").alias("doc_id"), F.col("pos").alias("line_no"), "line"
    )


@query
def s3_header_detection(spark, sf):
    return parsed(spark, sf).sources.select(
        "source_path", (F.col("header_fields") > 0).alias("has_header"), "header_fields"
    )


@query
def s4_parse_separate_header(spark, sf):
    return plain_rows(parsed(spark, sf, "separate").rows)


@query
def s5_parse_inline_header(spark, sf):
    return plain_rows(parsed(spark, sf, "inline").rows)


@query
def s6_parse_no_header(spark, sf):
    return plain_rows(parsed(spark, sf, "none").rows)


@query
def s6_parse_by_width(spark, sf):
    return plain_rows(parsed(spark, sf, "short", layout="by_width").rows)


@query
def s7_parse_ragged_rows(spark, sf):
    return plain_rows(parsed(spark, sf).rows)


@query
def s8_read_export_files(spark, sf):
    lines = exports.read_lines(spark, _write_exports(spark, sf))
    rows = parsing.parse_lines(lines).rows
    return rows.select(
        *[F.col(f"`{c}`") for c in COLUMNS], _folder("nation"), _folder("file"), "_line_number"
    )


@query
def s9_sources_without_rows(spark, sf):
    lines = export_lines(spark, sf)
    blank = table(spark, sf, "customer").select(
        F.concat(F.lit("lib/blank/"), "c_custkey", F.lit(".txt")).alias("source_path"),
        F.lit(1).alias("line_no"),
        F.lit(" \t ").alias("line"),
    )
    every = exports.lines_from_table(lines.unionByName(blank), "source_path", "line_no", "line")
    return report.report_files(parsing.parse_lines(every).sources)


@query
def s10_csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_csv(catalog_src(spark, sf).drop(EXTRA), path)
    return tables.read_csv(spark, path)


@query
def s11_csv_texts(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return tables.read_csv(spark, path, multi_line=True)


def _compiled_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    tables.write_csv(catalog_src(spark, sf).drop(EXTRA), path)
    return tables.compiled_from_csv(spark, path)


@query
def s11_csv_tracks(spark, sf):
    compiled = _compiled_csv(spark, sf)
    return tracks.with_track_ids(tracks.clean_tracks(compiled, max_year=MAX_YEAR))


@query
def s11_csv_extract_tracks(spark, sf):
    return tracks.extract_tracks(_compiled_csv(spark, sf))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "chunks")
    tables.write_chunks(tracks.chunk_documents(numbered(spark, sf)), path)
    return tables.read_chunks(spark, path)


@query
def s12_chunk_documents(spark, sf):
    return _chunks(spark, sf).select(
        "chunk",
        "totalChunks",
        "count",
        F.get("tracks", F.lit(0))["id"].alias("firstId"),
        F.element_at("tracks", -1)["id"].alias("lastId"),
        F.aggregate("tracks", F.lit(0).cast("bigint"), lambda s, t: s + t["duration"]).alias(
            "duration"
        ),
    )


def _index_json(spark, index, members, member, plural, count):
    path = scratch_path(spark, "index")
    tables.write_json(entities.entity_documents(index, members, member, plural), path)
    schema = (
        f"slug string, name string, {count} bigint, trackCount bigint, position bigint, "
        f"part int, {plural} array<string>"
    )
    documents = tables.read_json(spark, path, schema)
    return documents.withColumn(plural, F.array_join(plural, "|"))


@query
def s13_artist_index_json(spark, sf):
    rows = cleaned(spark, sf)
    members = entities.entity_members(rows, "artistSlug", "album")
    index = entities.artist_index(rows)
    return _index_json(spark, index, members, "album", "albums", "albumCount")


@query
def s14_album_index_json(spark, sf):
    rows = cleaned(spark, sf)
    members = entities.entity_members(rows, "albumSlug", "artist")
    index = entities.album_index(rows)
    return _index_json(spark, index, members, "artist", "artists", "artistCount")


@query
def s15_metadata_json(spark, sf):
    path = scratch_path(spark, "metadata")
    rows = cleaned(spark, sf)
    document = entities.metadata_document(
        entities.collection_stats(rows),
        entities.facet_values(rows, "genre"),
        entities.facet_values(rows, "year"),
    )
    tables.write_json(document, path)
    schema = (
        "part int, totalTracks bigint, totalArtists bigint, totalAlbums bigint, genres array<string>, "
        "years array<int>, stats struct<totalSizeBytes bigint, totalSizeGB double, "
        "totalDurationSeconds bigint, totalDurationHours double, totalDurationFormatted string, "
        "avgBitRate double, tracksWithRating bigint>"
    )
    back = tables.read_json(spark, path, schema)
    return back.select(
        "part",
        "totalTracks",
        "totalArtists",
        "totalAlbums",
        F.array_join("genres", "|").alias("genres"),
        F.array_join(F.col("years").cast("array<string>"), "|").alias("years"),
        "stats.*",
    )


def _extracted_json(spark: SparkSession, pairs: DataFrame, entity: str, member: str) -> DataFrame:
    path, plural = scratch_path(spark, "extracted"), f"{member}s"
    tables.write_json(entities.extracted_documents(pairs, entity, member, plural), path)
    schema = f"{entity} string, part int, {plural} array<string>, number bigint, total bigint"
    return tables.read_json(spark, path, schema).withColumn(plural, F.array_join(plural, "|"))


@query
def s16_extracted_json(spark, sf):
    return _extracted_json(spark, entities.extract_artists(catalog_src(spark, sf)), "artist", "album")


@query
def s16_extracted_albums_json(spark, sf):
    return _extracted_json(spark, entities.extract_albums(catalog_src(spark, sf)), "album", "artist")


@query
def s16_extracted_tracks_json(spark, sf):
    path = scratch_path(spark, "extracted")
    tables.write_json(tracks.extract_tracks(catalog_src(spark, sf)), path)
    return tables.read_json(spark, path, "track string, artist string, album string, seq bigint")


@query
def s17_report_files(spark, sf):
    return report.report_files(parsed(spark, sf).sources)


@query
def s17_report_fields(spark, sf):
    return parsing.unified_header(parsed(spark, sf).sources)


@query
def s17_report_stats(spark, sf):
    run = parsed(spark, sf)
    stats = report.run_statistics(
        report.report_files(run.sources), dedup.dedup_first(run.rows, CONTENT, "seq")
    )
    fields = parsing.unified_header(run.sources).agg(F.count(F.lit(1)).alias("n"))
    return stats.withColumn("unique_fields", fields.scalar())


@query
def s18_read_chunks(spark, sf):
    return tracks.tracks_of_chunks(_chunks(spark, sf))


# --- projections and predicates ----------------------------------------------------


@query
def p1_track_table(spark, sf):
    return numbered(spark, sf)


@query
def p2_extract_tracks(spark, sf):
    return tracks.extract_tracks(catalog_src(spark, sf))


@query
def p3_track_rows(spark, sf):
    return browse.track_rows(cleaned(spark, sf), BASE)


@query
def p3_track_rows_short(spark, sf):
    return browse.track_rows(cleaned(spark, sf), BASE, show_artist=False, show_album=False)


@query
def p4_filled_lines(spark, sf):
    return export_lines(spark, sf).filter(~C.is_blank("line"))


@query
def p5_named_rows(spark, sf):
    return catalog_src(spark, sf).filter(~C.is_blank("Name")).select("seq", "Name")


@query
def p6_valid_names(spark, sf):
    return catalog_src(spark, sf).select(
        "seq",
        C.is_valid_name("Artist").alias("valid_artist"),
        C.is_valid_name("Album").alias("valid_album"),
        C.is_valid_name("Composer").alias("valid_composer"),
    )


@query
def p7_default_names(spark, sf):
    return catalog_src(spark, sf).select(
        "seq",
        C.or_default(C.clean_artist("Artist"), "Unknown Artist").alias("artist"),
        C.or_default(C.clean_album("Album"), "Unknown Album").alias("album"),
    )


@query
def p8_members_if_filled(spark, sf):
    return entities.extract_artists(catalog_src(spark, sf))


@query
def p9_tracks_of_slug(spark, sf):
    return browse.tracks_of(cleaned(spark, sf), "artistSlug", LOOKUP).select(
        "seq", "name", "artist", "album"
    )


# --- joins -------------------------------------------------------------------------


def _with_regions(spark, sf, index: DataFrame, count: str) -> DataFrame:
    """Index rows plus the regions, which no track belongs to."""
    regions = table(spark, sf, "region").select(C.slug("r_name").alias("slug"), F.col("r_name"))
    return index.select("slug", "name", count).unionByName(
        regions.select("slug", F.col("r_name").alias("name"), F.lit(0).cast("bigint").alias(count))
    )


@query
def j1_artist_tracks(spark, sf):
    rows = cleaned(spark, sf)
    index = _with_regions(spark, sf, entities.artist_index(rows), "albumCount")
    few = rows.select("artistSlug", "seq", F.col("name").alias("track"), "album")
    return browse.entity_tracks(index, few, "artistSlug")


@query
def j2_album_tracks(spark, sf):
    rows = cleaned(spark, sf)
    index = _with_regions(spark, sf, entities.album_index(rows), "artistCount")
    few = rows.select("albumSlug", "seq", F.col("name").alias("track"), "artist")
    return browse.entity_tracks(index, few, "albumSlug")


@query
def j3_lines_with_header(spark, sf):
    return parsed(spark, sf).rows.select(
        "source_path", "_line_number", "Name", "Genre", "Location", flat_extra()
    )


# --- aggregations ------------------------------------------------------------------


@query
def a1_artist_index(spark, sf):
    return entities.artist_index(cleaned(spark, sf))


@query
def a1_artist_albums(spark, sf):
    return entities.entity_members(cleaned(spark, sf), "artistSlug", "album")


@query
def a2_album_index(spark, sf):
    return entities.album_index(cleaned(spark, sf))


@query
def a2_album_artists(spark, sf):
    return entities.entity_members(cleaned(spark, sf), "albumSlug", "artist")


@query
def a3_genres(spark, sf):
    return entities.facet_values(cleaned(spark, sf), "genre")


@query
def a4_years(spark, sf):
    return entities.facet_values(cleaned(spark, sf), "year")


@query
def a5_collection_stats(spark, sf):
    return entities.collection_stats(cleaned(spark, sf))


def _maintained(spark, sf):
    """States of all tracks, which come in two runs: the rated ones last."""
    tracks_ = cleaned(spark, sf)
    states = maintained.Maintained(spark, scratch_path(spark, "states"))
    rated = F.coalesce(F.col("rating"), F.lit(0)) > 0
    states.add(tracks_.filter(~rated))
    states.add(tracks_.filter(rated))
    return states


@query
def a1_index_of_runs(spark, sf):
    return _maintained(spark, sf).index("artists")


@query
def a2_index_of_runs(spark, sf):
    return _maintained(spark, sf).index("albums")


@query
def a5_stats_of_runs(spark, sf):
    return _maintained(spark, sf).stats()


@query
def a5d_distinct_sketches(spark, sf):
    """The estimates of merged sketches, which stay within a few in a hundred of the exact numbers."""
    tracks_ = cleaned(spark, sf)
    parts = [tracks_.filter(F.col("rating") > 0), tracks_.filter(F.coalesce("rating", F.lit(0)) <= 0)]
    exact = entities.distinct_slugs(tracks_)
    near = entities.sketched_counts(entities.merged_sketches([entities.slug_sketches(p) for p in parts]))
    near = stage(near, "sketched")

    def close(name: str) -> Column:
        guess = near.select(name).scalar()
        return (F.abs(guess - F.col(name)) <= F.greatest(0.03 * F.col(name), F.lit(1))).alias(f"{name}Close")

    return exact.select("totalArtists", "totalAlbums", close("totalArtists"), close("totalAlbums"))


@query
def a6_extract_artists(spark, sf):
    return entities.extract_artists(catalog_src(spark, sf))


@query
def a7_extract_albums(spark, sf):
    return entities.extract_albums(catalog_src(spark, sf))


@query
def a8_artist_detail(spark, sf):
    return browse.artist_detail(cleaned(spark, sf))


@query
def a9_artist_albums(spark, sf):
    return browse.artist_albums(cleaned(spark, sf))


@query
def a9_artist_album_tracks(spark, sf):
    few = cleaned(spark, sf).select("artistSlug", "album", "discNumber", "trackNumber", "seq")
    return browse.artist_album_tracks(few)


@query
def a10_album_detail(spark, sf):
    return browse.album_detail(cleaned(spark, sf))


@query
def a11_album_discs(spark, sf):
    return browse.album_discs(cleaned(spark, sf))


@query
def a12_artist_letters(spark, sf):
    return browse.letter_index(entities.artist_index(cleaned(spark, sf)), hash_others=False)


@query
def a13_album_letters(spark, sf):
    return browse.letter_index(entities.album_index(cleaned(spark, sf)), hash_others=True)


@query
def a13_text_letters(spark, sf):
    """Letter filing of document texts, which also start with accents and digits."""
    texts = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("slug"), F.col("text").alias("name"), "doc_id"
    )
    filled = texts.filter(~C.is_blank("name"))
    return browse.letter_index(
        filled.withColumn("position", F.col("doc_id")).drop("doc_id"), hash_others=True
    ).drop("name")


@query
def a14_dedup_first(spark, sf):
    docs = table(spark, sf, "documents")
    return dedup.dedup_first(docs, ["text"], "doc_id")


@query
def a14_dedup_in_runs(spark, sf):
    """Documents that come in three runs, one after the other, of a third each."""
    docs = table(spark, sf, "documents")
    runs = incremental.Runs(spark, scratch_path(spark, "runs"))
    cuts = docs.agg(F.percentile("doc_id", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c")).first()["c"]
    low, high = cuts or (0.0, 0.0)
    between = (F.col("doc_id") >= low) & (F.col("doc_id") < high)
    for part in (F.col("doc_id") < low, between, F.col("doc_id") >= high):
        runs.add_run(docs.filter(part), ["text"], "doc_id")
    return runs.compiled("doc_id").select("text", "doc_id", "copies")


@query
def a14_dedup_exports(spark, sf):
    run = parsed(spark, sf)
    return plain_rows(run.lineage_of(dedup.dedup_first(run.rows, CONTENT, "seq")))


@query
def a15_duplicates(spark, sf):
    docs = table(spark, sf, "documents")
    return dedup.duplicates(docs, ["text"], "doc_id").select("doc_id", "lang", "source")


@query
def a15_duplicate_rows(spark, sf):
    run = parsed(spark, sf)
    again = dedup.duplicates(run.rows, CONTENT, "seq")
    return again.select(
        F.col("Name").alias("name"), F.col("Artist").alias("artist"), "source_path", "_line_number"
    )


@query
def a16_run_statistics(spark, sf):
    run = parsed(spark, sf)
    return report.run_statistics(
        report.report_files(run.sources), dedup.dedup_first(run.rows, CONTENT, "seq")
    )


def _counted(spark, sf):
    """The files, and the counts that the write of their unique rows took along."""
    run = parsed(spark, sf)
    kept, counts = report.counted(dedup.dedup_first(run.rows, CONTENT, "seq"))
    kept.write.parquet(scratch_path(spark, "counted"))
    return report.report_files(run.sources), counts


@query
def a16_counted_while_written(spark, sf):
    return report.counted_statistics(*_counted(spark, sf))


@query
def a17_format_census(spark, sf):
    return report.format_census(report.report_files(parsed(spark, sf).sources))


# --- numbering, sorting, limits ----------------------------------------------------


@query
def w1_track_ids(spark, sf):
    return numbered(spark, sf).select("id", "seq", "name")


def _numbered(spark, sf, order):
    """Tracks under a number in ``order``, which come in three runs: rated, short, and other ones."""
    few = cleaned(spark, sf).select("artist", "album", "trackNumber", "seq", "name", "rating", "size")
    few = stage(few, "few")
    rated = F.coalesce(F.col("rating"), F.lit(0)) > 0
    small = F.coalesce(F.col("size") % 3 == 0, F.lit(False))
    store = numbering.Numbered(spark, scratch_path(spark, "numbered"), order)
    for part in (rated, ~rated & small, ~rated & ~small):
        store.add(few.filter(part))
    return store


@query
def w1_ids_of_runs(spark, sf):
    number = F.col("position") - 1
    track_id = F.concat(F.lit("track-"), C.padded(number, 5)).alias("id")
    return _numbered(spark, sf, ["seq"]).positions().select(track_id, number.alias("seq"), "name")


@query
def w2_first_and_last(spark, sf):
    return entities.entity_summary(
        cleaned(spark, sf), "albumSlug", "album", "artist", "artistCount"
    )


@query
def w3_chunk_numbers(spark, sf):
    return tracks.with_chunks(numbered(spark, sf).select("id", "seq"))


@query
def w4_track_pages(spark, sf):
    few = cleaned(spark, sf).select("artist", "album", "trackNumber", "seq")
    return browse.paginate(few, browse.site_order()).select("seq", "position", "page")


@query
def w4_pages_of_runs(spark, sf):
    page = F.floor((F.col("position") - 1) / browse.PAGE_SIZE) + 1
    numbers = _numbered(spark, sf, browse.site_order()).positions()
    return numbers.select("seq", "position", page.alias("page"))


@query
def o1_index_order(spark, sf):
    return entities.album_index(cleaned(spark, sf)).select("position", "name", "slug")


@query
def o2_code_point_order(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", "text")
    return global_positions(texts, ["text", "doc_id"]).drop("text")


@query
def o3_natural_order(spark, sf):
    return browse.natural_positions(entities.artist_index(cleaned(spark, sf))).select(
        "position", "name", "slug"
    )


@query
def o3_natural_order_texts(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", "text")
    return global_positions(texts, [C.natural_order("text"), "doc_id"]).drop("text")


@query
def o4_album_track_order(spark, sf):
    few = cleaned(spark, sf).select("albumSlug", "discNumber", "trackNumber", "seq")
    return browse.album_tracks(few)


@query
def o5_site_order(spark, sf):
    few = cleaned(spark, sf).select("artist", "album", "trackNumber", "seq")
    return global_positions(few, browse.site_order())


@query
def o6_source_order(spark, sf):
    return parsed(spark, sf).sources.select("source_path", "rank")


@query
def o7_letter_headings(spark, sf):
    filed = browse.letter_index(entities.album_index(cleaned(spark, sf)), hash_others=True)
    return browse.letters(filed, hash_last=True)


@query
def o7_letter_headings_artists(spark, sf):
    filed = browse.letter_index(entities.artist_index(cleaned(spark, sf)), hash_others=False)
    return browse.letters(filed, hash_last=False)


@query
def l1_facet_cloud(spark, sf):
    return entities.facet_cloud(entities.facet_values(cleaned(spark, sf), "composer"), "composer")


@query
def l2_artist_preview(spark, sf):
    pairs = cleaned(spark, sf).select("albumSlug", "artist").distinct()
    return entities.preview(pairs, ["albumSlug"], "artist")


@query
def l3_sample_artists(spark, sf):
    pairs = entities.extract_artists(catalog_src(spark, sf))
    return entities.sample_entities(pairs, "artist", "album")


@query
def l3_sample_albums(spark, sf):
    pairs = entities.extract_albums(catalog_src(spark, sf))
    return entities.sample_entities(pairs, "album", "artist")


@query
def l3_sample_tracks(spark, sf):
    return (
        tracks.extract_tracks(catalog_src(spark, sf)).orderBy("seq").limit(entities.SAMPLE_SIZE)
    )


@query
def l4_page_manifest(spark, sf):
    few = cleaned(spark, sf).select("artist", "album", "trackNumber", "seq")
    return browse.page_manifest(browse.paginate(few, browse.site_order()))


# --- set operations ----------------------------------------------------------------


@query
def u1_union_of_layouts(spark, sf):
    rows = parsed(spark, sf).rows
    return rows.select("source_path", "_line_number", *[F.col(f"`{c}`") for c in COLUMNS])


@query
def u2_unified_header(spark, sf):
    return parsing.unified_header(parsed(spark, sf).sources)


@query
def u3_unknown_columns(spark, sf):
    run = parsed(spark, sf)
    names = tables.extra_columns(parsing.unified_header(run.sources), (*COLUMNS, *LINEAGE))
    rows = run.rows.select("source_path", "_line_number", EXTRA)
    return tables.spread_extra(rows, names)


# --- scalar functions --------------------------------------------------------------


@query
def h1_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.slug("text").alias("slug"))


@query
def h1_slug_names(spark, sf):
    return catalog_src(spark, sf).select("seq", C.slug("Artist").alias("slug"))


@query
def h2_lenient_int(spark, sf):
    return catalog_src(spark, sf).select(
        "seq",
        C.lenient_int("Size").alias("size"),
        C.lenient_int("Disc Count", -1).alias("disc_count"),
        C.lenient_int("Volume Adjustment").alias("volume"),
        C.lenient_int("Name").alias("name"),
    )


@query
def h3_blank_to_null(spark, sf):
    return catalog_src(spark, sf).select(
        "seq",
        C.blank_to_null("Composer").alias("composer"),
        C.blank_to_null("Grouping").alias("grouping"),
    )


@query
def h4_clean_artist(spark, sf):
    return catalog_src(spark, sf).select("seq", C.clean_artist("Artist").alias("artist"))


@query
def h5_front_article(spark, sf):
    articles = F.array(*map(F.lit, ("The", "a", "AN", "le", "La", "LOS", "las", "el", "und")))
    article = F.element_at(articles, (F.col("c_custkey") % 9 + 1).cast("int"))
    names = F.concat(F.col("n_name"), F.lit(", "), article)
    joined = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select("c_custkey", C.front_article(names).alias("name"))


@query
def h6_clean_album(spark, sf):
    return catalog_src(spark, sf).select("seq", C.clean_album("Album").alias("album"))


@query
def h7_clean_genre(spark, sf):
    return catalog_src(spark, sf).select("seq", C.clean_genre("Genre").alias("genre"))


@query
def h8_clean_year(spark, sf):
    return catalog_src(spark, sf).select("seq", C.clean_year("Year", MAX_YEAR).alias("year"))


@query
def h9_minutes_seconds(spark, sf):
    seconds = C.lenient_int("Size")
    return catalog_src(spark, sf).select("seq", C.minutes_seconds(seconds).alias("length"))


@query
def h10_zero_to_null(spark, sf):
    volume = C.lenient_int("Volume Adjustment")
    return catalog_src(spark, sf).select(
        "seq", C.positive(volume).alias("above_zero"), C.nonzero(volume).alias("not_zero")
    )


def _totals(spark, sf) -> DataFrame:
    return cleaned(spark, sf).groupBy("artistSlug").agg(
        F.sum("size").alias("bytes"), F.sum("duration").alias("seconds")
    )


@query
def h11_size_and_hours(spark, sf):
    return _totals(spark, sf).select(
        "artistSlug",
        C.gigabytes("bytes").alias("gb"),
        C.hours("seconds").alias("hours"),
        C.hours_minutes("seconds").alias("hours_minutes"),
    )


@query
def h12_whole_days(spark, sf):
    return _totals(spark, sf).select("artistSlug", C.whole_days("seconds").alias("days"))


@query
def h13_thousands(spark, sf):
    return catalog_src(spark, sf).select(
        "seq", C.with_thousands(C.lenient_int("Size")).alias("size")
    )


@query
def h14_ascii_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.ascii_slug("text").alias("slug"))


@query
def h14_dangling_links(spark, sf):
    rows = cleaned(spark, sf)
    members = rows.select("albumSlug", "artist").distinct()
    return browse.dangling_artist_links(members, entities.artist_index(rows))


@query
def h15_links(spark, sf):
    pages = table(spark, sf, "pages")
    path = F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)
    return pages.select(
        "page_id", C.link("/music", path).alias("plain"), C.link("/music/", path).alias("closed")
    )


@query
def h16_split_tabs(spark, sf):
    fields = C.split_tabs("line")
    return export_lines(spark, sf).select(
        "source_path", "line_no", F.size(fields).alias("n"), F.element_at(fields, -1).alias("last")
    )


@query
def h17_first_letter(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        C.first_letter("text").alias("letter"),
        C.letter_or_hash("text").alias("heading"),
    )


@query
def h18_padded_names(spark, sf):
    chunk = F.floor(F.col("seq") / 10) + 1
    return cleaned(spark, sf).select(
        "seq",
        F.concat(F.lit("tracks-"), C.padded(chunk, 3), F.lit(".json")).alias("file"),
        F.array_join(F.array("artist", "album"), ", ").alias("label"),
    )


# --- search and gates --------------------------------------------------------------


@query
def t1_term_frequencies(spark, sf):
    docs = table(spark, sf, "documents")
    return search.term_frequencies(search.keyword_postings(docs, "doc_id", "text"))


@query
def t1_keyword_search(spark, sf):
    docs = table(spark, sf, "documents")
    postings = search.keyword_postings(docs, "doc_id", "text")
    return search.keyword_search(postings, "doc_id", TERMS)


@query
def t1_best_matches(spark, sf):
    docs = table(spark, sf, "documents")
    postings = search.keyword_postings(docs, "doc_id", "text")
    return search.best_matches(search.keyword_search(postings, "doc_id", TERMS), "doc_id")


@query
def s18_lookup_clustered(spark, sf):
    """The tracks of one artist out of a table laid out by slug."""
    path = scratch_path(spark, "by-slug")
    lookup.write_clustered(cleaned(spark, sf), path, "artistSlug", "seq")
    return lookup.look_up(spark, path, "artistSlug", LOOKUP).select("seq", "name", "artistSlug", "albumSlug")


def word_index(spark, sf):
    path = scratch_path(spark, "word-index")
    inverted.build_index(table(spark, sf, "documents"), "doc_id", "text", path)
    return inverted.Index(spark, path)


@query
def t1_ranked_search(spark, sf):
    return word_index(spark, sf).ranked(RANKED).withColumnRenamed("doc", "doc_id")


@query
def t1_phrase_search(spark, sf):
    return word_index(spark, sf).phrase(PHRASE).withColumnRenamed("doc", "doc_id")


@query
def t1_prefix_search(spark, sf):
    return word_index(spark, sf).prefix(PREFIX).withColumnRenamed("doc", "doc_id")


@query
def t1_completions(spark, sf):
    return word_index(spark, sf).completions(PREFIX)


@query
def q1_require_rows(spark, sf):
    run = parsed(spark, sf)
    kept = report.require_rows(dedup.dedup_first(run.rows, CONTENT, "seq"))
    return kept.agg(F.count(F.lit(1)).alias("unique_rows"))


@query
def q2_reconcile(spark, sf):
    run = parsed(spark, sf)
    files = report.report_files(run.sources)
    stats = report.run_statistics(files, dedup.dedup_first(run.rows, CONTENT, "seq"))
    return report.reconcile(files, stats)


@query
def q2_reconcile_counted(spark, sf):
    files, counts = _counted(spark, sf)
    return report.reconcile(files, report.counted_statistics(files, counts))
