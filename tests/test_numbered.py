"""Numbers under appends against a full sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalogforge.operators.numbered import Numbered

SCHEMA = "k long, name string, block string, `key` int, position string, i long"


def rows(seed: int, start: int, count: int, low: int = 0, high: int = 50):
    """Few keys, some null, so most repeat; columns clash with those of the store."""
    draw = random.Random(seed)
    return [
        (draw.choice([None, draw.randrange(low, high)]) if draw.random() < 0.2 else draw.randrange(low, high),
         draw.choice(["a", "B", None]), "clash", 7, "clash", start + j)
        for j in range(count)
    ]


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or "", row[5])


@pytest.mark.parametrize(
    "parts",
    [
        [(0, 0, 0, 50), (1, 90, 0, 50), (2, 0, 0, 50)],
        # All of a later run falls behind, before, or into one block of an earlier one.
        [(4, 60, 100, 150), (5, 80, 150, 160), (6, 70, 0, 5), (7, 90, 120, 121)],
    ],
)
def test_numbers_equal_a_full_sort(spark, tmp_path, parts):
    store = Numbered(spark, str(tmp_path / "numbered"), ["k", "name", "i"], block_rows=10)
    assert store.positions() is None
    assert store.page(1, 10) is None
    assert store.count() == 0
    every = []
    for run, (seed, count, low, high) in enumerate(parts):
        part = rows(seed, len(every), count, low, high)
        assert store.add(spark.createDataFrame(part, SCHEMA).repartition(3)) == run
        every += part
        assert store.count() == len(every)
    wanted = [r[5] for r in sorted(every, key=order)]
    found = store.positions()
    assert found.columns == ["k", "name", "block", "key", "i", "position"]
    assert [(r.i, r.position) for r in found.orderBy("position").collect()] == [(i, n) for n, i in enumerate(wanted, 1)]
    for page in (1, 3, 99):
        got = [r.i for r in store.page(page, 13).orderBy("position").collect()]
        assert got == wanted[(page - 1) * 13 : page * 13]
    assert store.blocks().agg(F.max("n")).first()[0] <= 20


def test_repeated_rows_keep_the_order_of_runs(spark, tmp_path):
    store = Numbered(spark, str(tmp_path / "numbered"), [F.lower("name")], block_rows=4)
    for run in range(2):
        same = [(1, "Same", "x", run, "y", j) for j in range(9)]
        store.add(spark.createDataFrame(same, SCHEMA))
    found = store.positions().orderBy("position").collect()
    assert [r.key for r in found] == [0] * 9 + [1] * 9
    assert [r.position for r in found] == list(range(1, 19))


def test_an_append_writes_its_own_rows_and_a_page_reads_its_blocks(spark, tmp_path):
    store = Numbered(spark, str(tmp_path / "numbered"), ["k", "i"], block_rows=20)
    first = [(j, "n", "b", 0, "p", j) for j in range(200)]
    store.add(spark.createDataFrame(first, SCHEMA))
    store.add(spark.createDataFrame([(5, "new", "b", 0, "p", 1000), (150, "new", "b", 0, "p", 1001)], SCHEMA))
    assert spark.read.parquet(f"{store.out}/run=1/rows").count() == 2
    page = store.page(1, 15)
    assert [r.i for r in page.orderBy("position").collect()] == [0, 1, 2, 3, 4, 5, 1000, *range(6, 14)]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "block" in plan.split("PushedFilters: [")[1].split("]")[0]
    # An append behind everything cuts the last block only.
    store.add(spark.createDataFrame([(300 + j, "late", "b", 0, "p", 2000 + j) for j in range(30)], SCHEMA))
    assert spark.read.parquet(f"{store.out}/run=2/rows").count() == 50
    assert store.count() == 232


def test_a_run_that_fails_before_its_commit_does_not_count(spark, tmp_path, monkeypatch):
    store = Numbered(spark, str(tmp_path / "numbered"), ["k", "name", "i"], block_rows=10)
    store.add(spark.createDataFrame(rows(1, 0, 30), SCHEMA))
    monkeypatch.setattr(Numbered, "_commit", lambda self, run: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.add(spark.createDataFrame(rows(2, 30, 30), SCHEMA))
    monkeypatch.undo()
    assert store.count() == store.positions().count() == 30
    assert store.add(spark.createDataFrame(rows(3, 60, 5), SCHEMA)) == 1
    assert store.count() == store.positions().count() == 35
