"""Tracks, indexes and listings against brute force on a skewed fixture."""

from __future__ import annotations

import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalogforge.operators import browse, entities, report, search, tracks
from catalogforge.plans import catalog
from catalogforge.sources import tables
from catalogforge.sources.schema import COLUMNS, TRACK_COLUMNS

ARTISTS = ["Abba", "ABBA!", '"Beatles, The"', "Björk", "10cc", "éa", "", "??", "a  b", "a-b"]
ALBUMS = ["Gold", '"Gold"', "10", "Ü", "", "?", "zed", "Gold!"]


def compiled_rows(n: int = 2500):
    rng = random.Random(11)
    out = []
    for i in range(n):
        values = dict.fromkeys(COLUMNS, "")
        hot = rng.random() < 0.4
        values["Name"] = rng.choice(["", " "]) if rng.random() < 0.02 else f" Song {i}"
        values["Artist"] = f"Guest {i}" if hot else rng.choice(ARTISTS)
        values["Album"] = "" if hot else rng.choice(ALBUMS)
        values["Genre"] = rng.choice(["Rock", "blues", "World", "12", ""])
        values["Year"] = rng.choice(["1999", "2003", "44100", "", "1251"])
        values["Size"] = rng.choice(["1000", "5.5", "x", ""])
        values["Time"] = str(rng.randrange(500))
        values["Bit Rate"] = rng.choice(["0", "128", "192", "-1"])
        values["Track Number"] = str(rng.randrange(12))
        values["Disc Number"] = str(rng.randrange(3))
        values["My Rating"] = str(rng.randrange(3))
        values["Volume Adjustment"] = rng.choice(["0", "-3", "2"])
        out.append((i * 3 + 1, values))
    return out


@pytest.fixture(scope="module")
def compiled(spark):
    rows = [(seq, *[v[c] for c in COLUMNS]) for seq, v in compiled_rows()]
    schema = "seq long, " + ", ".join(f"`{c}` string" for c in COLUMNS)
    return spark.createDataFrame(rows, schema).repartition(6)


@pytest.fixture(scope="module")
def rows(spark, compiled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tracks") / "t")
    tracks.build_tracks(compiled, max_year=2024).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def local(rows):
    return sorted(rows.collect(), key=lambda r: r.seq)


def test_tracks(rows, local):
    assert rows.columns == [*TRACK_COLUMNS, "seq"]
    assert [r.id for r in local] == [f"track-{i:05d}" for i in range(len(local))]
    kept = [
        v for _, v in compiled_rows()
        if v["Name"].strip() and v["Artist"] != "??" and v["Album"] != "?"
    ]
    assert [r.name for r in local] == [v["Name"].strip() for v in kept]
    for r, v in zip(local, kept, strict=True):
        if v["Artist"] == "":
            assert (r.artist, r.artistSlug) == ("Unknown Artist", "unknown-artist")
        if v["Artist"].startswith('"'):
            assert r.artist == "The Beatles"
        assert r.album == (v["Album"].strip('"') or "Unknown Album")
        assert r.genre == (v["Genre"] if v["Genre"].isalpha() else None)
        assert r.year == (int(v["Year"]) if v["Year"] not in ("", "44100") else None)
        assert r.size == {"1000": 1000, "5.5": 5}.get(v["Size"], 0)
        assert r.durationFormatted == "%d:%02d" % divmod(int(v["Time"]), 60)
        assert r.bitRate == (int(v["Bit Rate"]) if int(v["Bit Rate"]) > 0 else None)
        assert r.trackNumber == (int(v["Track Number"]) or None)
        assert r.volumeAdjustment == (int(v["Volume Adjustment"]) or None)
        assert r.rating == int(v["My Rating"])


def test_indexes(rows, local):
    for fn, slug, name, member, count in (
        (entities.artist_index, "artistSlug", "artist", "album", "albumCount"),
        (entities.album_index, "albumSlug", "album", "artist", "artistCount"),
    ):
        want = {}
        for r in local:
            entry = want.setdefault(r[slug], {"n": 0, "members": set()})
            entry["name"] = r[name]
            entry["members"].add(r[member])
            entry["n"] += 1
        order = sorted(want.items(), key=lambda kv: kv[1]["name"].lower())
        got = fn(rows).orderBy("position").collect()
        assert [(r.slug, r.name, r[count], r.trackCount) for r in got] == [
            (s, e["name"], len(e["members"]), e["n"]) for s, e in order
        ]
        assert sum(r.trackCount for r in got) == len(local)
        members = entities.entity_members(rows, slug, member).collect()
        assert sorted((r.slug, r.position, r[member]) for r in members) == sorted(
            (s, i, m) for s, e in want.items() for i, m in enumerate(sorted(e["members"]), 1)
        )


def test_documents_come_in_parts(rows):
    index = entities.album_index(rows)
    members = entities.entity_members(rows, "albumSlug", "artist")
    parts = entities.entity_documents(index, members, "artist", "artists", part_size=100)
    hot = parts.filter("slug = 'unknown-album'").orderBy("part").collect()
    assert [r.part for r in hot] == list(range(1, len(hot) + 1)) and len(hot) > 5
    assert all(len(r.artists) == 100 for r in hot[:-1])
    names = [a for r in hot for a in r.artists]
    assert names == sorted(names) and len(names) == hot[0].artistCount


def test_stats_and_metadata(spark, rows, local):
    got = entities.collection_stats(rows).first()
    rates = [r.bitRate for r in local if r.bitRate]
    seconds = sum(r.duration for r in local)
    assert got.totalTracks == len(local)
    assert got.totalArtists == len({r.artistSlug for r in local})
    assert got.totalSizeBytes == sum(r.size for r in local)
    assert got.totalDurationSeconds == seconds
    assert got.totalDurationHours == round(seconds / 3600, 1)
    assert got.avgBitRate == round(sum(rates) / len(rates), 1)
    assert got.tracksWithRating == sum(r.rating > 0 for r in local)
    genres = entities.facet_values(rows, "genre")
    years = entities.facet_values(rows, "year")
    doc = entities.metadata_document(entities.collection_stats(rows), genres, years).first()
    assert doc.genres == ["Rock", "World", "blues"]
    assert doc.years == [1251, 1999, 2003]
    assert doc.stats.totalSizeBytes == got.totalSizeBytes
    parts = entities.metadata_document(entities.collection_stats(rows), genres, years, part_size=2)
    found = parts.orderBy("part").collect()
    assert [(r.part, r.genres) for r in found] == [(1, ["Rock", "World"]), (2, ["blues"])]
    assert {tuple(r.years) for r in found} == {(1251, 1999, 2003)}
    none = genres.filter("position < 0")
    lone = entities.metadata_document(entities.collection_stats(rows), none, years).collect()
    assert [(r.part, r.genres) for r in lone] == [(1, [])]
    empty = entities.collection_stats(rows.filter("seq < 0")).first()
    assert (empty.totalTracks, empty.totalSizeBytes, empty.avgBitRate) == (0, 0, 0.0)


def test_extractors(compiled):
    artists: dict[str, set] = {}
    listed = []
    for _, v in compiled_rows():
        artist = v["Artist"].strip('"')
        artist = "The Beatles" if artist == "Beatles, The" else artist
        if artist and artist != "??":
            artists.setdefault(artist, set()).update([v["Album"]] if v["Album"] else [])
            if v["Album"].strip("?") and v["Name"].strip():
                listed.append((v["Name"].strip(), artist, v["Album"]))
    got = entities.extract_artists(compiled)
    assert sorted((r.artist, r.position, r.album or "") for r in got.collect()) == sorted(
        (a, i, m) for a, ms in artists.items() for i, m in enumerate(sorted(ms) or [""], 1)
    )
    docs = entities.extracted_documents(got, "artist", "album", "albums").collect()
    assert {r.artist: r.albums for r in docs} == {a: sorted(m) for a, m in artists.items()}
    places = {a: i for i, a in enumerate(sorted(artists), 1)}
    assert {r.artist: r.number for r in docs} == places
    assert {r.total for r in docs} == {len(places)}
    rows = tracks.extract_tracks(compiled).orderBy("seq").collect()
    assert [(r.track, r.artist, r.album) for r in rows] == listed


def test_details(rows, local):
    def key(r):
        return (r.discNumber or 0, r.trackNumber or 0, r.seq)

    albums: dict[str, list] = {}
    for r in local:
        albums.setdefault(r.albumSlug, []).append(r)
    got = {r.albumSlug: r for r in browse.album_detail(rows).collect()}
    assert {k: (v.trackCount, v.minutes, v.year) for k, v in got.items()} == {
        k: (len(v), sum(r.duration for r in v) // 60, min(v, key=key).year)
        for k, v in albums.items()
    }
    placed = {r.id: r.position for r in browse.album_tracks(rows).collect()}
    assert placed == {
        r.id: i for v in albums.values() for i, r in enumerate(sorted(v, key=key), 1)
    }
    discs = {(r.albumSlug, r.disc): r for r in browse.album_discs(rows).collect()}
    for slug, v in albums.items():
        numbers = {r.discNumber or 1 for r in v}
        for n in numbers:
            d = discs.pop((slug, n))
            assert d.trackCount == sum((r.discNumber or 1) == n for r in v)
            assert d.showHeading == (len(numbers) > 1)
    assert not discs
    detail = {r.artistSlug: r for r in browse.artist_detail(rows).collect()}
    for slug in {r.artistSlug for r in local}:
        own = [r for r in local if r.artistSlug == slug]
        d = detail[slug]
        assert (d.trackCount, d.albumGroups, d.minutes) == (
            len(own), len({r.album for r in own}), sum(r.duration for r in own) // 60,
        )


def test_joins_keep_entities_without_tracks(spark, rows):
    index = entities.artist_index(rows).select("slug")
    extra = spark.createDataFrame([("nobody",)], "slug string")
    few = rows.select("artistSlug", "id")
    got = browse.entity_tracks(index.union(extra), few, "artistSlug").collect()
    assert [r.id for r in got if r.slug == "nobody"] == [None]
    assert sorted(r.id for r in got if r.id) == sorted(r.id for r in few.collect())
    assert all(r.slug == r.artistSlug for r in got if r.id)


def test_letters(rows):
    index = entities.album_index(rows)
    filed = browse.letter_index(index, hash_others=True)
    headings = browse.letters(filed, hash_last=True).orderBy("position").collect()
    assert [r.letter for r in headings] == ["G", "U", "Z", "#"]
    assert sum(r.entries for r in headings) == index.count()
    artists = browse.letters(
        browse.letter_index(entities.artist_index(rows), hash_others=False), hash_last=False
    )
    letters = [r.letter for r in artists.orderBy("position").collect()]
    assert letters == sorted(letters) and "É" in letters and "1" in letters


def test_pages(rows):
    pages = browse.paginate(rows, browse.site_order())
    manifest = browse.page_manifest(pages).orderBy("page").collect()
    n = rows.count()
    total = -(-n // 100)
    assert [tuple(r) for r in manifest] == [
        (p, total, n, (p - 1) * 100 + 1, min(p * 100, n)) for p in range(1, total + 1)
    ]


def test_previews(spark):
    pairs = spark.createDataFrame(
        [("x", m) for m in "dcba"] + [("y", "q"), ("y", "p"), ("z", None)], "slug string, m string"
    )
    got = {r.slug: (r.n, r.preview) for r in entities.preview(pairs, ["slug"], "m").collect()}
    assert got == {"x": (4, "a, b +2 more"), "y": (2, "p, q"), "z": (0, "")}
    sample = {r.slug: r.preview for r in entities.sample_entities(pairs, "slug", "m").collect()}
    assert sample == {"x": "a, b, c ... (+1 more)", "y": "p, q", "z": ""}
    facet = spark.range(1, 61).select(F.col("id").alias("position"), F.col("id").alias("v"))
    cloud = entities.facet_cloud(facet, "v").collect()
    assert len(cloud) == 50 and {r.more for r in cloud} == {10}


def test_track_rows(rows):
    r = browse.track_rows(rows, "/m").filter("artistLink like '%beatles%'").first()
    assert r.artistLink == "/m/artists/the-beatles"
    short = browse.track_rows(rows, show_artist=False, show_album=False)
    assert short.columns == ["seq", "name", "year", "duration"]


def test_dangling_links(rows):
    members = entities.entity_members(rows, "albumSlug", "artist")
    got = browse.dangling_artist_links(members, entities.artist_index(rows)).collect()
    assert {r.artist: r.linkSlug for r in got if not r.artist.startswith("Guest")} == {
        "ABBA!": "abba-", "Björk": "bj-rk", "éa": "-a",
    }


def test_chunks(spark, rows, local, tmp_path):
    docs = tracks.chunk_documents(rows, size=1000)
    tables.write_chunks(docs, str(tmp_path / "a"))
    tables.write_chunks(docs, str(tmp_path / "b"), folder_per_chunk=True)
    assert (tmp_path / "b" / "name=tracks-001").is_dir()
    for name in "ab":
        back = tables.read_chunks(spark, str(tmp_path / name))
        total = -(-len(local) // 1000)
        heads = sorted((r.chunk, r.totalChunks, r["count"]) for r in back.collect())
        sizes = [1000] * (total - 1) + [len(local) - 1000 * (total - 1)]
        assert heads == [(i, total, n) for i, n in enumerate(sizes, 1)]
        read = tracks.tracks_of_chunks(back).orderBy("id").drop("chunk").collect()
        assert [tuple(r) for r in read] == [tuple(r)[:-1] for r in local]


def test_csv_round_trip(spark, tmp_path):
    values = [' a "b" ', "", '"', "x,y", "\\", "  ", "tab\tbed", 'a\\"b', "é", None]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "k string, v string")
    tables.write_csv(df, str(tmp_path / "c"))
    got = {r.k: r.v for r in tables.read_csv(spark, str(tmp_path / "c")).collect()}
    assert got == {str(i): v or "" for i, v in enumerate(values)}


def test_catalogue_job(spark, compiled, local, tmp_path):
    out = str(tmp_path / "cat")
    catalog.build_catalogue(spark, compiled, out, max_year=2024)
    catalog.build_listings(spark, out, str(tmp_path / "list"))
    catalog.extract_entities(compiled, str(tmp_path / "ext"))
    assert spark.read.parquet(f"{out}/tracks").count() == len(local)
    parts = [p for p in Path(out, "json", "metadata").glob("part-*") if p.stat().st_size]
    [doc] = [json.loads(line) for p in parts for line in p.read_text().splitlines()]
    assert doc["totalTracks"] == len(local) and doc["genres"] == ["Rock", "World", "blues"]
    assert spark.read.parquet(str(tmp_path / "list" / "album_tracks")).count() == len(local)
    assert spark.read.json(str(tmp_path / "ext" / "tracks")).count() > 0


def test_search(spark):
    docs = spark.createDataFrame(
        [(1, "The rain, the RAIN"), (2, "rain’s end"), (3, "Été 42"), (4, "")],
        "id long, text string",
    )
    postings = search.keyword_postings(docs, "id", "text")
    assert {(r.term, r.id, r.hits) for r in postings.collect()} == {
        ("the", 1, 2), ("rain", 1, 2), ("rain", 2, 1), ("s", 2, 1), ("end", 2, 1),
        ("été", 3, 1), ("42", 3, 1),
    }
    got = search.keyword_search(postings, "id", ["Rain", "end", "rain"]).collect()
    assert {(r.id, r.matched, r.hits) for r in got} == {(1, 1, 2), (2, 2, 2)}
    [best] = search.best_matches(search.keyword_search(postings, "id", ["rain"]), "id", 1).collect()
    assert best.id == 1
    freq = {r.term: (r.texts, r.hits) for r in search.term_frequencies(postings).collect()}
    assert freq["rain"] == (2, 3)


def test_require_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        report.require_rows(spark.createDataFrame([], "a string"))


def test_hot_slug_spreads_over_tasks(spark):
    """Without adaptive execution, a slug of 90% of the tracks fills several tasks."""
    index = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "slug string, n int")
    few = spark.range(4000).selectExpr(
        "id as seq", "if(id % 10 = 0, 'cold', 'hot') as artistSlug", "cast(id as string) as name"
    )
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = browse.entity_tracks(index, few, "artistSlug").withColumn("_task", F.spark_partition_id())
        rows = got.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.slug, r.seq) for r in rows if r.seq is not None) == sorted(
        ("cold" if i % 10 == 0 else "hot", i) for i in range(4000)
    )
    assert [(r.slug, r.n) for r in rows if r.seq is None] == [("none", 3)]
    hot = Counter(r._task for r in rows if r.slug == "hot")
    assert max(hot.values()) < 0.6 * sum(hot.values())


def test_wide_projections_run_in_compiled_parts(spark):
    """``clean_tracks`` lowers the limit of generated methods from Spark's default, and nothing else."""
    key, was = tracks.METHOD_KEY, spark.conf.get(tracks.METHOD_KEY)
    compiled = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in COLUMNS) + ", seq long")
    try:
        for given, then in ((tracks.METHOD_DEFAULT, tracks.METHOD), ("4000", "4000")):
            spark.conf.set(key, given)
            tracks.clean_tracks(compiled)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, was)
