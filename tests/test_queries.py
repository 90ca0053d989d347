"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalogforge import functions as C
from checks.compare import compare, connect
from checks.oracles import ORACLES, heading, letter
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.queries()) == set(QUERIES) | set(entry.LLM_QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLES) | set(entry.LLM_ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert compare(spark, con, name, SF_DIR) == ""


def test_letters_of_the_sql_are_those_of_the_functions(spark, con):
    """Over all first letters up to the last plane that has cases, ``ß`` and ``ŉ`` among them."""
    held = "i NOT BETWEEN 55296 AND 57343 AND i <> 65279"
    sql = f"SELECT i, {letter('chr(i)')}, {heading('chr(i)')} FROM (SELECT i::INT i FROM range(1, 131072) t(i)) WHERE {held}"
    want = {i: (first, head) for i, first, head in con.execute(sql).fetchall()}
    code = F.decode(F.unhex(F.lpad(F.hex("i"), 8, "0")), "UTF-32")
    rows = spark.range(1, 131072).withColumnRenamed("id", "i").filter(held).select("i", code.alias("t"))
    got = rows.select("i", C.first_letter("t").alias("first"), C.letter_or_hash("t").alias("head")).collect()
    assert {r["i"]: (r["first"], r["head"]) for r in got} == want
    assert want[0xDF] == ("SS", "SS") and want[0xC9] == ("É", "#")
