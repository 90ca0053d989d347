"""Run registered queries against their SQL: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from catalogforge.session import local_session
from checks.oracles import ORACLES
from checks.queries import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return round(value, 6)
    return value


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


# Types that hold the same values in both engines.
SAME_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str:
    """An empty string if both engines agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    have = sorted((c, SAME_TYPES.get(t, t)) for c, t in df.dtypes)
    need = sorted((d[0], str(d[1])) for d in cur.description)
    want = _rows(columns, cur.fetchall())
    if have != need:
        return f"schema {sorted(set(have) - set(need))} != {sorted(set(need) - set(have))}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got != want:
        diff = next(((g, w) for g, w in zip(got, want, strict=False) if g != w), None)
        return f"rows {len(got)} != {len(want)}; first difference {diff}"
    return ""


def main(argv: list[str]) -> int:
    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'ok'}"[:1500], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
