"""Small tables with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

import pytest

LONG = "Word number one and two. " * 8000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.\nAnd then it sleeps."),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.\nAnd then it sleeps."),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.\nAnd then it sleeps."),
    (3, ""),
    (4, None),
    (5, LONG),
    (6, "one"),
    (7, "é漢🙂 \t\n  x  \x1c y\n\n"),
    (8, "a" * 30_000),
    (9, "mail bob@example.com or +1 212 555 0100, 10.0.0.1, 4111 1111 1111 1111 <|endoftext|> end"),
    (None, "a text without an id"),
    (10, "ab " * 400),
]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp string, `key` int,"
    " score string, _base string, shard string, label array<int>"
)


def rows_of(texts):
    langs = ["en", None, "fr"]
    return [
        (i, t, langs[k % 3], None, None if t is None else len(t), "x", k, None, "b", "s", None)
        for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    def build(texts):
        return spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")

    return build


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1, 12)] + [(None, 1, 0), (3, None, None), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    rows = [
        (1, "quick brown fox jumps over the lazy dog near the old river"),
        (2, None),
        (None, ""),
        (3, "Alice bought 12 kg of apples for 30 dollars and gave Bob 12 kg today"),
        (3, "Alice bought 12 kg of apples for 30 dollars and gave Bob 12 kg today"),
        (4, "quite short"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")
