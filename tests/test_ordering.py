"""Positions against brute force, with one group holding most rows."""

from __future__ import annotations

import random

from catalogforge.operators.ordering import (
    _totals_before,
    dense_sequence,
    first_per_group,
    global_positions,
    group_positions,
)


def rows(n: int = 3000):
    rng = random.Random(7)
    keys = rng.sample(range(10**12), n)
    groups = [None if i % 17 == 0 else "hot" if rng.random() < 0.6 else f"g{i % 40}" for i in range(n)]
    return [(k, g, rng.randrange(50)) for k, g in zip(keys, groups, strict=True)]


def test_dense_sequence(spark):
    data = rows()
    df = spark.createDataFrame(data, "k long, g string, v int").repartition(7)
    got = {r.k: r.n for r in dense_sequence(df, "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(r[0] for r in data))}


def test_dense_sequence_of_neighbours(spark):
    df = spark.range(0, 200_000, numPartitions=5).withColumnRenamed("id", "k")
    assert dense_sequence(df, "k", "n", start=1).filter("n <> k + 1").count() == 0


def test_totals_before_over_blocks(spark):
    keys = spark.range(0, 50_000).selectExpr("id * 37 AS key", "id % 5 AS n")
    got = {r.key: r.before for r in _totals_before(keys, "key").collect()}
    total = 0
    for i in range(50_000):
        assert got[i * 37] == total
        total += i % 5


def test_global_positions(spark):
    data = rows()
    df = spark.createDataFrame(data, "k long, g string, v int").repartition(5)
    got = {r.k: r.position for r in global_positions(df, ["v", "k"]).collect()}
    order = sorted(data, key=lambda r: (r[2], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order, 1)}


def test_group_positions(spark):
    data = rows()
    df = spark.createDataFrame(data, "k long, g string, v int").repartition(5)
    got = {r.k: r.position for r in group_positions(df, ["g"], ["v", "k"]).collect()}
    want, seen = {}, {}
    for k, g, _ in sorted(data, key=lambda r: (r[2], r[0])):
        seen[g] = want[k] = seen.get(g, 0) + 1
    assert got == want


def test_first_per_group(spark):
    data = [r for r in rows() if r[1]]
    df = spark.createDataFrame(data, "k long, g string, v int").repartition(5)
    plan = first_per_group(df, ["g"], ["v", "k"], 2)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.g, r.k) for r in plan.collect())
    want = []
    for g in {r[1] for r in data}:
        want += [(g, r[0]) for r in sorted((r for r in data if r[1] == g), key=lambda r: (r[2], r[0]))[:2]]
    assert got == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "k long, g string")
    assert global_positions(df, ["k"]).count() == 0
    assert group_positions(df, ["g"], ["k"]).count() == 0
    assert dense_sequence(df, "k", "n").count() == 0
