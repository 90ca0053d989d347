"""Runs in parts against one run over all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalogforge.operators import incremental
from catalogforge.operators.dedup import dedup_first

CONTENT = ("name", "artist", "year", "extra")
SCHEMA = "name string, artist string, year int, extra array<struct<name:string,value:string>>, seq long, other string"


def rows(seed: int, start: int, n: int):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        hot = draw.random() < 0.35
        name = "hot" if hot else draw.choice(["a", "b", "", None, "a1", "1a"]) 
        artist = "hot" if hot else draw.choice(["x", "", None, "1:x"])
        year = None if hot else draw.choice([1, 2, None])
        extra = None if hot or draw.random() < 0.5 else [("k", str(draw.randrange(3)))]
        out.append((name, artist, year, extra, start + i, "clash"))
    return out


@pytest.mark.parametrize("parts", [[50], [40, 1, 60], [30, 0, 30, 30]])
def test_parts_equal_one_run(spark, tmp_path, parts):
    runs = incremental.Runs(spark, str(tmp_path / "runs"))
    assert runs.compiled("seq") is None
    every, start = [], 0
    for i, n in enumerate(parts):
        part = rows(i, start, n)
        assert runs.add_run(spark.createDataFrame(part, SCHEMA).repartition(3), CONTENT, "seq") == i
        every, start = every + part, start + n
    whole = dedup_first(spark.createDataFrame(every, SCHEMA), CONTENT, "seq")
    found = runs.compiled("seq").select(whole.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.collect()))


def test_a_run_that_fails_before_its_commit_does_not_count(spark, tmp_path, monkeypatch):
    runs = incremental.Runs(spark, str(tmp_path / "runs"))
    runs.add_run(spark.createDataFrame(rows(1, 0, 20), SCHEMA), CONTENT, "seq")
    before = sorted(map(repr, runs.compiled("seq").collect()))
    monkeypatch.setattr(incremental.Runs, "_commit", lambda self, run: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        runs.add_run(spark.createDataFrame(rows(2, 100, 20), SCHEMA), CONTENT, "seq")
    assert sorted(map(repr, runs.compiled("seq").collect())) == before
    monkeypatch.undo()
    assert runs.add_run(spark.createDataFrame(rows(2, 100, 20), SCHEMA), CONTENT, "seq") == 1


def test_two_runs_cannot_take_one_number(spark, tmp_path):
    runs = incremental.Runs(spark, str(tmp_path / "runs"))
    runs._commit(0)
    with pytest.raises(Exception, match="exists"):
        runs._commit(0)


def test_filters_lose_nothing_and_merge(spark, monkeypatch):
    monkeypatch.setattr(incremental, "WORDS", 16)
    monkeypatch.setattr(incremental, "BUCKETS", 4)
    digests = spark.range(2000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    held, other = digests.filter("id < 400"), digests.filter("id >= 1000")
    halves = [incremental.filters(held.filter(f"id % 2 = {i}")) for i in (0, 1)]
    both = incremental.merged(halves)
    assert sorted(both.collect()) == sorted(incremental.filters(held).collect())
    assert incremental.may_hold(held, both).count() == 400
    assert incremental.may_hold(other, both).count() < 500


def test_a_second_run_reads_changed_files_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.txt", "b.txt", "c.txt"):
        (folder / name).write_text(name)
    first = incremental.manifest(spark, str(folder), ["*.txt"])
    kept = spark.createDataFrame(first.collect(), first.schema)
    (folder / "b.txt").write_text("other")
    (folder / "c.txt").unlink()
    (folder / "d.txt").write_text("new")
    (folder / "a.txt").touch()
    now = incremental.manifest(spark, str(folder), ["*.txt"])
    found = {r["source_path"].rsplit("/", 1)[1]: r["change"] for r in incremental.differences(kept, now).collect()}
    assert found == {"b.txt": "changed", "c.txt": "gone", "d.txt": "added"}


def test_totals_without_expanded_rows(spark):
    from catalogforge.operators import entities

    slug = F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 700))
    tracks = spark.range(20_000).select(
        slug.alias("artistSlug"), F.concat(F.lit("b"), F.col("id") % 2000).alias("albumSlug"),
        F.lit(1).alias("bitRate"), F.lit(2).alias("size"), F.lit(3).alias("duration"), F.lit(4).alias("rating"),
    )
    stats = entities.collection_stats(tracks)
    assert "Expand" not in stats._jdf.queryExecution().executedPlan().toString()
    assert (stats.first()["totalArtists"], stats.first()["totalAlbums"]) == (700, 2000)
    parts = [entities.slug_sketches(tracks.filter(F.col("size") + i == 2)) for i in (0, 1)]
    near = entities.sketched_counts(entities.merged_sketches(parts)).first()
    assert abs(near["totalArtists"] - 700) <= 14 and abs(near["totalAlbums"] - 2000) <= 40
