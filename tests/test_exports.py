"""Export files of every layout, against a line-by-line reading of the same bytes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalogforge.operators import dedup, entities, parsing, report, tracks
from catalogforge.plans.compile import compile_exports
from catalogforge.sources import exports, tables
from catalogforge.sources.schema import COLUMNS, COLUMNS_BY_WIDTH, CONTENT, HEADER_WORDS

H18, H25 = COLUMNS_BY_WIDTH[19], COLUMNS_BY_WIDTH[26]


def row(n: int, prefix: str = "v") -> str:
    return "\t".join(f"{prefix}{i}" for i in range(n))


FILES = {
    # Header on its own line; short and long rows; blank and continuation lines.
    "a-b/Library.export001": "\r".join(
        ["\t".join(H18) + "\t1", row(19), row(3), row(25), "  ", "x", row(18) + "\t 9"]
    ),
    "a/Library.export002": "\n".join([row(19, "p"), row(19, "p"), "", row(26, "q")]) + "\n",
    "a/z+ y%.txt": "\r\n".join([row(25), row(25, "w"), row(3)]),
    "d.txt": row(26) + "\r" + row(26, "w"),
    "e.txt": "\t".join(H25) + "\t296\r" + row(25) + "\r",
    # Header and first row on one line, then more rows.
    "f.txt": "\t".join(COLUMNS) + "\t" + row(26) + "\n" + row(26, "w"),
    # Header without a last name that ends it; a name used twice; unknown names.
    "g.txt": "Name\tArtist\tAlbum\tGenre\tSize\tTime\n" + row(6),
    "h.txt": "Name\tMood\tArtist\tAlbum\tName\tGenre\tTempo\tLocation\n" + row(8) + "\na\t\tb",
    # Four known names are no header, five are.
    "four.txt": "Name\tArtist\tAlbum\tGenre\tx\tLocations\n" + row(6),
    "five.txt": "Name\tArtist\tAlbum\tGenre\tx\tLocation\n" + row(6),
    # Blank lines first; an empty name first, whose tab the outer strip takes.
    "blank-first.txt": "\n \t\n\tArtist only\tx\n" + row(4) + " \t\n\n",
    "one-line.txt": "  lonely\tline  \t ",
    "blank.txt": " \r\n\t\r\n",
    "empty.txt": "",
    "bad.txt": b"caf\xe9\tx\xff\xc3(\ty\xe2\x82\n\xf0\x9f\x98\x80\tok",
    "validation_report.txt": "not\tan\texport",
    "notes.csv": "not\tan\texport",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    for name, content in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return root


def detect(fields: list[str]) -> int:
    if sum(f in HEADER_WORDS for f in fields[:15]) < 5:
        return 0
    return fields.index("Location") + 1 if "Location" in fields else min(27, len(fields) // 2)


def kind(fields: list[str]) -> str:
    width = detect(fields)
    if not width:
        return "no_header"
    return "header+data" if len(fields) > width + 5 else "separate_header"


def brute(root, layout: str = "positional"):
    """Rows in path order as (relative path, line number, {column: value}), and formats."""
    found, formats = [], {}
    names = [p for p in root.rglob("*") if p.is_file()]
    for path in sorted(names):
        name = path.name
        if name == "validation_report.txt" or not (
            name.endswith(".txt") or name.startswith("Library.export")
        ):
            continue
        text = path.read_bytes().decode("utf-8", "replace")
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        key = str(path.relative_to(root))
        top = text.split("\n")[0].strip().split("\t")
        formats[key] = (kind(top), len(top))
        lines = text.strip().split("\n")
        first = lines[0].split("\t")
        width, how = detect(first), kind(first)
        names_ = first[:width] or list(COLUMNS)
        if not width and layout == "by_width":
            names_ = list(COLUMNS_BY_WIDTH.get(len(first), COLUMNS))
        for number, line in enumerate(lines, 1):
            fields = line.split("\t")
            if number == 1 and how == "separate_header":
                continue
            if number == 1 and how == "header+data":
                fields = fields[width:]
            elif not line.strip():
                continue
            padded = fields + [""] * len(names_)
            values = dict(zip(names_, padded, strict=False))
            found.append((key, number, {k: v for k, v in values.items() if v}))
    return found, formats


def as_values(r) -> dict[str, str]:
    values = {c: r[c] for c in COLUMNS if r[c]}
    return values | {e.name: e.value for e in r.extra}


def collected(run, root):
    prefix = f"file:{root}/"
    rows = run.rows.orderBy("seq").collect()
    return [(r.source_path.removeprefix(prefix), r._line_number, as_values(r)) for r in rows]


@pytest.mark.parametrize("layout", ["positional", "by_width"])
def test_parse(spark, folder, layout):
    run = parsing.parse_lines(exports.read_lines(spark, str(folder)), layout)
    want, _ = brute(folder, layout)
    assert collected(run, folder) == want


def test_parse_split_files(spark, tmp_path):
    """Files cut into many splits keep their line numbers and headers."""
    rng = random.Random(3)
    for i in range(3):
        lines = ["\t".join(H25) + "\t1"] if i else ["", " "]
        for n in range(4000):
            lines.append("" if rng.random() < 0.1 else row(rng.randrange(1, 30), f"r{n}."))
        (tmp_path / f"{i}.txt").write_bytes(["\n", "\r", "\r\n"][i].join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        lines = exports.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20
        run = parsing.parse_lines(lines)
        assert collected(run, tmp_path) == brute(tmp_path)[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_shuffle_join_gives_the_same(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        run = parsing.parse_lines(exports.read_lines(spark, str(folder)))
        assert collected(run, folder) == brute(folder)[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_from_table_and_texts(spark):
    text = "\n".join(["\t".join(H18) + "\t1", row(19), "", row(5)])
    texts = spark.createDataFrame([("x/one", text), ("x/two", row(26))], "path string, text string")
    from_texts = parsing.parse_lines(exports.lines_from_texts(texts, "path", "text"))
    numbered = [("x/one", i, v) for i, v in enumerate(text.split("\n"), 1)] + [("x/two", 1, row(26))]
    df = spark.createDataFrame(numbered, "path string, n int, line string")
    from_lines = parsing.parse_lines(exports.lines_from_table(df, "path", "n", "line"))
    rows = from_texts.rows.orderBy("seq").collect()
    assert rows == from_lines.rows.orderBy("seq").collect()
    assert [(r._source_file, r._line_number, r.Location) for r in rows] == [
        ("one", 2, "v17"), ("one", 4, ""), ("two", 1, "v25"),
    ]


def test_reports(spark, folder):
    run = parsing.parse_lines(exports.read_lines(spark, str(folder)))
    found = exports.discover_exports(spark, str(folder))
    files = report.with_unread_files(report.report_files(run.sources), found)
    prefix = f"file:{folder}/"
    got = {r.source_path.removeprefix(prefix): r for r in files.collect()}
    rows, formats = brute(folder)
    assert {k: (r.format, r.field_count) for k, r in got.items()} == formats
    assert {k: r.n_rows for k, r in got.items() if r.n_rows} == {
        k: sum(1 for x in rows if x[0] == k) for k in {x[0] for x in rows}
    }
    assert sorted(k for k, r in got.items() if not r.n_rows) == ["blank.txt", "empty.txt"]
    census = report.format_census(files).first()
    assert census.header_plus_data == 1
    assert census.separate_header + census.no_header == len(formats) - 1
    fields = [r.field for r in parsing.unified_header(run.sources).orderBy("ordinal").collect()]
    assert fields == [*COLUMNS, "Mood", "Tempo", "x", "_source_file", "_line_number"]


def test_compile(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    compiled = compile_exports(spark, str(folder), out, csv=True, skip_unreadable=True, list_duplicates=True)
    rows, _ = brute(folder)
    first = {}
    for key, number, values in rows:
        first.setdefault(tuple(sorted(values.items())), (key, number))
    prefix = f"file:{folder}/"
    got = compiled.orderBy("seq").collect()
    assert [
        (r.source_path.removeprefix(prefix), r._line_number, tuple(sorted(as_values(r).items())))
        for r in got
    ] == [(*place, content) for content, place in first.items()]
    stats = spark.read.parquet(f"{out}/report_stats").first()
    assert (stats.total_rows, stats.unique_rows) == (len(rows), len(first))
    assert stats.duplicates_removed == len(rows) - len(first) > 0
    assert spark.read.parquet(f"{out}/duplicates").count() == stats.duplicates_removed
    assert (stats.files_processed, stats.empty_files) == (15, 2)
    assert spark.read.parquet(f"{out}/report_balance").first().balanced
    scanned = report.run_statistics(spark.read.parquet(f"{out}/report_files"), compiled)
    assert scanned.columns == spark.read.parquet(f"{out}/report_stats").columns
    assert scanned.first().asDict() == stats.asDict()
    assert [r.source_path.removeprefix(prefix) for r in
            spark.read.parquet(f"{out}/report_errors").collect()] == []
    csv = tables.read_csv(spark, f"{out}/csv")
    assert csv.columns[-7:-2] == ["Mood", "Tempo", "x", "_source_file", "_line_number"]
    assert csv.count() == len(first)
    back = tables.compiled_from_csv(spark, f"{out}/csv")
    again = back.orderBy("seq").collect()
    assert [as_values(r) for r in again] == [as_values(r) for r in got]
    assert [(r.seq, r.source_path) for r in again] == [(r.seq, r.source_path) for r in got]
    built = tracks.build_tracks(back, max_year=2024)
    assert built.orderBy("id").collect() == tracks.build_tracks(compiled, max_year=2024).orderBy("id").collect()


def test_csv_of_few_columns(spark, tmp_path):
    """A file without most columns builds; one without an order does not."""
    path = str(tmp_path / "csv")
    rows = [("b", "X", "2"), ("a", "Y", "1"), ("c", "", "3")]
    tables.write_csv(spark.createDataFrame(rows, "Name string, Artist string, seq string"), path)
    back = tables.compiled_from_csv(spark, path)
    assert [r.name for r in tracks.build_tracks(back).orderBy("id").collect()] == ["a", "b", "c"]
    assert entities.extract_artists(back).count() == 2
    tables.write_csv(spark.createDataFrame([("a",)], "Name string"), f"{path}2")
    with pytest.raises(ValueError, match="order"):
        tables.compiled_from_csv(spark, f"{path}2")


def test_more_than_a_thousand_unknown_columns(spark):
    fields = spark.createDataFrame([(i, f"u{i}") for i in range(1200)], "ordinal int, field string")
    assert len(tables.extra_columns(fields, ())) == 1200


@pytest.mark.parametrize("rank", [2**27 - 2, 2**28 - 2, 2**40])
def test_order_key_beyond_many_segments(spark, folder, monkeypatch, rank):
    """Order, dedup and lineage hold however many segments come before."""
    measure = parsing.measure_segments
    monkeypatch.setattr(
        parsing, "measure_segments", lambda lines: measure(lines).withColumn("rank", F.col("rank") + rank)
    )
    run = parsing.parse_lines(exports.read_lines(spark, str(folder)))
    assert collected(run, folder) == brute(folder)[0]
    kept = run.lineage_of(dedup.dedup_first(run.rows, CONTENT, "seq")).orderBy("seq").collect()
    first = {}
    for key, number, values in brute(folder)[0]:
        first.setdefault(tuple(sorted(values.items())), (key, number))
    prefix = f"file:{folder}/"
    assert [(r.source_path.removeprefix(prefix), r._line_number) for r in kept] == list(first.values())
    ids = tracks.with_track_ids(tracks.clean_tracks(run.rows, max_year=2024)).orderBy("seq")
    assert [r.id for r in ids.collect()] == sorted(r.id for r in ids.collect())


def test_order_key_says_when_it_is_full():
    assert parsing.offset_bits(2**27, 2**34) == 28
    with pytest.raises(ValueError, match="order key"):
        parsing.offset_bits(2**40, 2**30)


def test_lost_rows_fail_the_compile(spark):
    rows = [(10, 9, 9, 0, False)]
    names = "expected_rows long, total_rows long, unique_rows long, duplicates_removed long, balanced boolean"
    with pytest.raises(ValueError, match="add up"):
        report.require_balance(spark.createDataFrame(rows, names))


def test_nothing_to_compile(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(" \n")
    with pytest.raises(ValueError, match="no rows"):
        compile_exports(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_changed_input_is_noticed(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 3, "b")], "path string, n int, line string")
    run = parsing.parse_lines(exports.lines_from_table(df, "path", "n", "line"))
    with pytest.raises(Exception, match="lines changed"):
        run.rows.collect()


def test_duplicates_of_copies(spark):
    """A content held by most rows is kept once, first in order, and whole."""
    data = [(i, "same" if i % 3 else f"r{i}", None if i % 2 else "") for i in range(5000)]
    df = spark.createDataFrame(data, "k long, a string, b string").repartition(6)
    kept = {r.a: (r.k, r.copies) for r in dedup.dedup_first(df, ["a", "b"], "k").collect()}
    assert kept["same"] == (1, sum(1 for d in data if d[1] == "same"))
    again = {r.k for r in dedup.duplicates(df, ["a", "b"], "k").collect()}
    assert again == {d[0] for d in data} - {k for k, _ in kept.values()}


@pytest.mark.parametrize("name", ["_hidden.txt", ".hidden.txt", "_sub/Library.export1", "a/b/.x.txt"])
def test_hidden_exports_fail_the_compile(spark, tmp_path, name):
    (tmp_path / "in" / name).parent.mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text(row(5))
    exports.require_visible(spark, str(tmp_path / "in"))
    (tmp_path / "in" / name).write_text(row(5))
    (tmp_path / "in" / "_other").write_text("not an export")
    with pytest.raises(ValueError, match="hidden names"):
        compile_exports(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_measuring_sorts_no_text(spark, monkeypatch):
    """The aggregate over all lines is hashed; sorting it would hold all text of a task."""
    plans = []
    stage = parsing.stage

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(parsing, "stage", seen)
    rows = [("a", 1, " "), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "z"), ("c", 1, "")]
    lines = spark.createDataFrame(rows, "path string, no int, line string")
    found = parsing.measure_segments(exports.lines_from_table(lines, "path", "no", "line"))
    got = {r.source_path: (r.n_lines, r.n_filled, r.top_line, r.first_line) for r in found.collect()}
    assert got == {"a": (3, 2, " ", "x"), "b": (1, 1, "z", "z"), "c": (1, 0, "", None)}
    assert plans and "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]


def test_export_lines_are_numbered_once_and_narrow(spark):
    """Rows are numbered before they become lines, by one sort."""
    from checks.source import export_lines

    plan = export_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
