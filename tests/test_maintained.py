"""Indexes and totals of runs against a rebuild over all tracks."""

from __future__ import annotations

import random

import pytest

from catalogforge.operators import entities, maintained

SCHEMA = (
    "artistSlug string, artist string, albumSlug string, album string, seq long, size long,"
    " duration long, bitRate int, rating int, n string, first string"
)


def rows(seed: int, start: int, count: int):
    """Tracks of which a third share one slug under two names; columns ``n`` and ``first`` clash."""
    draw = random.Random(seed)
    out = []
    for i in range(count):
        slug = "hot" if draw.random() < 0.35 else draw.choice(["a", "b", None, ""])
        artist = None if slug is None else draw.choice([slug, slug.upper()])
        album = draw.choice(["x", "X", "y", None])
        numbers = [draw.choice([None, 0, draw.randrange(1, 400)]) for _ in range(4)]
        out.append((slug, artist, album and album.lower(), album, start + i, *numbers, "clash", "clash"))
    return out


def same(found, wanted):
    assert found.columns == wanted.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))


def compare(states, whole):
    same(states.index("artists"), entities.artist_index(whole))
    same(states.index("albums"), entities.album_index(whole))
    same(states.members("albums"), entities.entity_members(whole, "albumSlug", "artist"))
    same(states.stats(), entities.collection_stats(whole))


@pytest.mark.parametrize("parts", [[0], [40, 0, 50], [30, 30]])
def test_runs_equal_a_rebuild(spark, tmp_path, parts):
    states = maintained.Maintained(spark, str(tmp_path / "states"))
    assert states.index("artists") is None
    assert states.stats() is None
    every, start = [], 1000
    for i, count in enumerate(parts):
        # Later runs may come before earlier ones in the order.
        start -= count
        part = rows(i, start, count)
        assert states.add(spark.createDataFrame(part, SCHEMA).repartition(3)) == i
        every += part
    whole = spark.createDataFrame(every, SCHEMA)
    compare(states, whole)
    small = states.compacted(str(tmp_path / "small"))
    compare(small, whole)
    assert small.committed() == [0]
    with pytest.raises(ValueError, match="holds runs"):
        states.compacted(str(tmp_path / "small"))


def test_a_run_that_fails_before_its_commit_does_not_count(spark, tmp_path, monkeypatch):
    states = maintained.Maintained(spark, str(tmp_path / "states"))
    first, second = rows(1, 0, 30), rows(2, 30, 30)
    states.add(spark.createDataFrame(first, SCHEMA))
    monkeypatch.setattr(maintained.Maintained, "_commit", lambda self, run: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        states.add(spark.createDataFrame(second, SCHEMA))
    compare(states, spark.createDataFrame(first, SCHEMA))
    monkeypatch.undo()
    assert states.add(spark.createDataFrame(second, SCHEMA)) == 1
    compare(states, spark.createDataFrame(first + second, SCHEMA))
