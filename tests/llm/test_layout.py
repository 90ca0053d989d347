"""Alignment, sharding and manifest against plain restatements."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogforge.llm import alignment, manifest, queries, sharding
from catalogforge.llm.bpe import vocabulary_path
from catalogforge.llm.pieces import Known, Pieces, after_text, byte_level
from tests.llm.conftest import SCHEMA, TEXTS, rows_of

HARD = [
    "", " ", "  lead", "trail ", "a  b   c", "x \n y\t\tz ", "▁ under", "<s> </s> <|endoftext|> <unk>", "é漢🙂🙂",
    "word,word. word!\n\nNext  line", "\x00\x01 nul", "a" * 500, "12345 67890 0x0A <0x41>", "　wide blank",
]


# --- op11 ---------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(alignment.PIECE_MODEL))


def spelled(libraries, text):
    """``(id, bytes)`` of both libraries' tokens, or nothing."""
    if not text:
        return [], []
    letters = alignment._byte_letters()
    a, b = libraries
    of_a = [
        (i, bytes(letters[c] for c in a.id_to_token(i)))
        for i in a.encode(" " + text, add_special_tokens=False).ids
    ]
    of_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        of_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(s for _, s in side) != whole for side in (of_a, of_b)):
        return [], []
    return of_a, of_b


def plainly_aligned(libraries, texts):
    out, held = [], Counter()
    for text in texts:
        spans = []
        for side in spelled(libraries, text):
            ends = np.cumsum([len(s) for _, s in side]).tolist()
            spans.append([(i, e - len(s), e) for (i, s), e in zip(side, ends, strict=True)])
        a, b = spans
        cuts = [0, *sorted({e for *_, e in a} & {e for *_, e in b})]
        groups = [
            "|".join(",".join(str(i) for i, s, e in side if x <= s and e <= y) for side in (a, b))
            for x, y in pairwise(cuts)
        ]
        links = [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]
        held.update(set(links))
        out.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (
            n_a, n_b, len(groups), len(links),
            sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in out
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def key(row):
    return tuple((x is None, x) for x in row)


def test_alignment_equals_a_plain_one(spark, odd, libraries):
    texts = [(i, t) for i, t in TEXTS if t is None or len(t) < 5000]
    texts += [(100 + i, t) for i, t in enumerate(HARD)]
    expected = plainly_aligned(libraries, [t for _, t in texts])
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    found = alignment.summary(docs).select("doc_id", *COLUMNS).collect()
    assert sorted(map(tuple, found), key=key) == sorted(
        ((i, *e) for (i, _), e in zip(texts, expected, strict=True)), key=key
    )


def test_alignment_of_small_slices_is_the_same(spark, make, monkeypatch, libraries):
    texts = list(enumerate(HARD * 3))
    expected = plainly_aligned(libraries, [t for _, t in texts])
    monkeypatch.setattr(alignment, "SLICE", 50)
    found = alignment.summary(make(texts)).select("doc_id", *COLUMNS).collect()
    assert sorted(map(tuple, found)) == [(i, *e) for i, e in enumerate(expected)]


def test_alignment_lists_groups(make, libraries):
    row = alignment.alignments(make([(1, "hello new world"), (2, None)])).orderBy("doc_id").collect()
    a, b = spelled(libraries, "hello new world")
    assert row[0]["a_ids"] == [i for i, _ in a]
    assert row[0]["b_ids"] == [i for i, _ in b]
    assert row[0]["a_ends"][-1] == len(a) and row[0]["b_ends"][-1] == len(b)
    assert row[1]["a_ids"] == [] and row[1]["a_ends"] == []


def test_alignment_of_nothing(empty):
    assert alignment.summary(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_shared_cuts_are_all_common_ends(seed):
    draw = np.random.default_rng(seed)
    n = int(draw.integers(1, 400))
    dense = draw.random() * 0.9 + 0.05
    a = np.flatnonzero(np.append(draw.random(n) < dense, True))
    b = np.flatnonzero(np.append(draw.random(n) < draw.random(), True))
    cut = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a)]))
    assert cut.tolist() == np.isin(a, b).tolist()


def test_a_long_interval_without_cuts_is_one_group():
    a, b = np.append(np.arange(1, 400_001, 2), 400_002), np.append(np.arange(2, 400_001, 2), 400_002)
    cut = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a)]))
    assert cut.sum() == 1


@pytest.mark.parametrize("memory", [0, 500, 1 << 20])
def test_pieces_give_what_the_libraries_give(libraries, memory, monkeypatch):
    a, b = libraries
    monkeypatch.setattr("catalogforge.llm.pieces.SEGMENT", 40)
    monkeypatch.setattr("catalogforge.llm.pieces.LONGEST", 6)
    texts = [t for _, t in TEXTS if t and len(t) < 5000] + HARD * 2
    source = open(vocabulary_path(), encoding="utf-8").read()
    model = open(vocabulary_path(alignment.PIECE_MODEL), "rb").read()
    for tokens, whole in (
        (alignment.byte_tokens(source), lambda t: a.encode(" " + t, add_special_tokens=False).ids),
        (alignment.piece_tokens(model), lambda t: b.encode(t)),
    ):
        tokens.pieces.memory = memory
        for _ in range(2):
            ids, sizes, _ = tokens.pieces.encode(texts)
            ends = np.cumsum(sizes)
            for text, x, y in zip(texts, ends - sizes, ends, strict=True):
                if text:
                    assert ids[x:y].tolist() == whole(text), text


def test_first_pieces_without_a_blank(libraries):
    a, _ = libraries
    blank = np.array([(a.id_to_token(i) or "").startswith("Ġ") for i in range(a.get_vocab_size())])
    pieces = Pieces(lambda p: [a.encode(x, add_special_tokens=False).ids for x in p], byte_level, blank, lead=False)
    for text in ("the the", "the", " the", "", "a  b"):
        ids, sizes, _ = pieces.encode([text, text])
        assert ids.tolist() == 2 * a.encode(text, add_special_tokens=False).ids
    assert after_text("a  b c ") == ["a", " b", "c", ""]


def test_only_distinct_pieces_of_a_slice_are_looked_up(libraries, monkeypatch):
    a, _ = libraries
    looked_up = []

    class Counting(Known):
        def __getitem__(self, piece):
            looked_up.append(piece)
            return super().__getitem__(piece)

    monkeypatch.setattr("catalogforge.llm.pieces.Known", Counting)
    blank = np.array([(a.id_to_token(i) or "").startswith("Ġ") for i in range(a.get_vocab_size())])
    for lead in (False, True):
        pieces = Pieces(lambda p: [a.encode(x, add_special_tokens=False).ids for x in p], byte_level, blank, lead)
        texts = ["the cat and the dog " * 500 + "end", "", "two  blanks\n the cat", "the", " the cat", "the cat"]
        looked_up.clear()
        ids, sizes, good = pieces.encode(texts)
        whole = [a.encode(" " + t if lead else t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(x) for x in whole] and good.all()
        assert ids.tolist() == [i for x in whole for i in x]
        assert len(looked_up) < 25


# --- op12 ---------------------------------------------------------------------------------


def spread_of(rows, shards):
    sums = Counter({s: 0 for s in range(shards)})
    for row in rows:
        sums[row["shard"]] += row["size"]
    return max(sums.values()) - min(sums.values())


def check_shards(rows, texts, shards):
    key = sorted((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == key
    of_text = defaultdict(set)
    by_shard = defaultdict(list)
    for row in rows:
        of_text[bytes(row["item"])].add(row["shard"])
        by_shard[row["shard"]].append(row)
    assert all(len(s) == 1 for s in of_text.values())
    assert set(by_shard) <= set(range(shards))
    for held in by_shard.values():
        held.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in held] == list(range(len(held)))
        ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in held]
        assert ids == sorted(ids)


def test_shards_of_odd_rows(odd):
    rows = sharding.assign(odd).collect()
    check_shards(rows, TEXTS, sharding.SHARDS)


def test_shards_of_nothing(empty):
    assert sharding.assign(empty).count() == 0


def test_shards_in_rounds_stay_tight(spark, make, monkeypatch):
    draw = np.random.default_rng(5)
    texts = [(i, "x" * int(n) + str(i)) for i, n in enumerate(draw.pareto(1.5, 1500) * 50)]
    texts += [(2000 + i, "the same text " * 20) for i in range(40)]
    whole = sharding.assign(make(texts), 6).collect()
    monkeypatch.setattr(sharding, "LAST", 400)
    monkeypatch.setattr(sharding, "BLOCK", 64)
    monkeypatch.setattr(sharding, "LIGHT", 100)
    monkeypatch.setattr(sharding, "HEAVY", 48)
    rounds = sharding.assign(make(texts), 6).collect()
    for rows in (whole, rounds):
        check_shards(rows, texts, 6)
        assert spread_of(rows, 6) <= 24


def test_a_heavy_group_has_a_shard_of_its_own(make):
    texts = [(i, "heavy" * 50) for i in range(200)] + [(1000 + i, f"light {i}") for i in range(400)]
    rows = sharding.assign(make(texts), 4).collect()
    heavy = {r["shard"] for r in rows if r["doc_id"] < 200}
    assert len(heavy) == 1
    assert not any(r["shard"] in heavy for r in rows if r["doc_id"] >= 200)
    light = [r for r in rows if r["doc_id"] >= 200]
    sums = Counter()
    for r in light:
        sums[r["shard"]] += r["size"]
    assert len(sums) == 3 and max(sums.values()) - min(sums.values()) <= 20


def test_differencing_combines_the_largest_spreads():
    # The textbook case: 8 7 6 5 4 differ by 2 when differenced.
    part = sharding.difference([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, p in zip([8, 7, 6, 5, 4], part, strict=True) if p == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2


def test_written_shards_hold_all_rows(spark, make, tmp_path):
    texts = [(i, f"text {i % 7} " * (i % 7)) for i in range(60)]
    sharding.write(make(texts), str(tmp_path / "out"), 3)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == sorted(texts)
    assert found.select("shard").distinct().count() == 3


# --- op13 ---------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    if value is None:
        return "-"
    return f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def plain_manifest(rows):
    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        head = field(doc_id) + field(source) + field(lang) + field(n_chars)
        leaf = digest(head + field(text))
        lowered = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        tampered = digest(head + field(lowered)) if touched else leaf
        trees[(source is not None, (source or "").encode())].append((doc_id is not None, doc_id, leaf, tampered))
    order = sorted(trees)
    for name in order:
        trees[name].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    built = {name: levels_of([r[2] for r in trees[name]]) for name in order}
    top = levels_of([built[name][-1][0] for name in order])
    out = []
    for at, name in enumerate(order):
        for i, (_, doc_id, leaf, tampered) in enumerate(trees[name]):
            folded, others = tampered, []
            for levels, j in ((built[name], i), (top, at)):
                for level in levels[:-1]:
                    run = level[j - j % 16 : j - j % 16 + 16]
                    others += run[: j % 16] + run[j % 16 + 1 :]
                    folded = digest(*run[: j % 16], folded, *run[j % 16 + 1 :])
                    j //= 16
            root = top[-1][0]
            out.append((doc_id, leaf, built[name][-1][0], root, digest(*others), folded, folded == root))
    return out


def some_rows(sizes):
    rows, at = [], 0
    for source, n in sizes:
        for _ in range(n):
            text = None if at % 11 == 3 else "" if at % 11 == 4 else f"Text Number {at % 50} É"
            rows.append((at, source, [None, "en", ""][at % 3], None if at % 7 == 0 else at * 3, text))
            at += 1
    return rows


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(
    "sizes",
    [
        [("a", 1)],
        [(None, 1), ("", 16), ("a", 17), ("b", 255), ("é", 256), ("z", 257)],
        [("hot", 4500), (None, 3)],
        [(f"s{i}", 1 + i % 3) for i in range(300)],
    ],
)
def test_manifest_equals_a_plain_one(spark, sizes):
    rows = some_rows(sizes)
    docs = spark.createDataFrame(rows, MANIFEST).withColumn("tree", F.lit("clash")).repartition(4)
    found = manifest.Manifest(docs).checks().collect()
    assert sorted(map(tuple, found), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = manifest.Manifest(odd).checks().collect()
    assert sorted(map(tuple, found), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_nothing(empty):
    assert manifest.Manifest(empty).checks().count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 600, 4096, 4097])
def test_positions_are_those_of_a_walk(n):
    counts = [n]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // 16))
    walked = []

    def walk(level, index):
        if level:
            for child in range(16 * index, min(16 * index + 16, counts[level - 1])):
                walk(level - 1, child)
        walked.append((level, index))

    walk(len(counts) - 1, 0)
    assert [manifest.position(level, index, n) for level, index in walked] == list(range(len(walked)))


def test_written_log_is_whole_and_in_postorder(spark, tmp_path):
    rows = some_rows([("a", 700), ("b", 5)])
    manifest.Manifest(spark.createDataFrame(rows, MANIFEST)).write(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log" / "sources")).collect()
    for tree, total in (("+a", 700 + 44 + 3 + 1), ("+b", 6)):
        assert sorted(r["position"] for r in log if r["tree"] == tree) == list(range(total))


def test_sql_of_the_manifest(spark, tmp_path):
    rows = some_rows([(None, 2), ("", 16), ("a", 17), ("b", 300), ("é", 5)] + [(f"s{i}", 1) for i in range(20)])
    docs = spark.createDataFrame(rows, MANIFEST)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = con.sql(queries.ORACLES["op13_merkle_manifest"]).project(", ".join(names)).fetchall()
    assert sorted(found, key=key) == sorted(plain_manifest(rows), key=key)
