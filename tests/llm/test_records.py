"""Archives, token ids, personal data, decontamination and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from catalogforge.llm import bpe, decontaminate, pii, token_files, warc
from catalogforge.llm.queries import QUERIES
from tests.llm.conftest import TEXTS


@pytest.fixture(scope="module")
def folder(odd, labels, benchmark_items, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    benchmark_items.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


# --- archives ------------------------------------------------------------------------


def test_op4_round_trip(spark, tmp_path, monkeypatch):
    pages = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "é", "漢" * 2000)]
    pages += [(6, "u", "same"), (7, "u", "a\r\n\r\nb"), (None, "n", "same"), (7, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    index = warc.write(df, f"file://{tmp_path}/out")
    records = warc.read_bundles(index).collect()
    largest = {}
    for i, _, html in pages:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, html in pages:
        raw, top = (html or "").encode(), largest[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[i, len(raw), digest, "response" if i == top else "revisit", None if i == top else top] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records)
    assert got == want
    for entry in index.collect():
        assert warc.read_record(entry.asDict())["record_id"] == entry.record_id
    assert warc.archive(df.limit(0)).count() == 0


def test_frames_are_independent(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 500)
    bundle = warc._Bundle(str(tmp_path), "x.warc.zst", 0)
    digest = hashlib.sha1(b"p" * 300).hexdigest()
    for i in range(9):
        bundle.add(i, warc._record(i, "u", b"p" * 300, digest, 300, None))
    rows = bundle.close()
    with open(tmp_path / "x.warc.zst", "rb") as file:
        import pyarrow as pa

        frames = warc.read_seek_table(pa.PythonFile(file))
    assert len(frames) > 2 and {r[3] for r in rows} == set(range(len(frames)))
    keys = ("record_id", "page_id", "bundle", "frame", "frame_at", "frame_size", "place", "size")
    for row in rows:
        assert warc.read_record(dict(zip(keys, row, strict=True)))["page_id"] == row[1]


# --- token ids -----------------------------------------------------------------------


def test_encoder_equals_the_library(library):
    with open(bpe.vocabulary_path(), encoding="utf-8") as file:
        own = bpe.Encoder(file.read())
    rnd = random.Random(9)
    letters = "abcdefgthe inging  \n\t'.,!?0123ÀéßΩя漢🙂  -_<|>\x1c\x85"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))) for _ in range(1500)]
    texts += ["x\n <|endoftext|> y<|endoftext|>", "a" * 4000, "don't I'll 've", "  lead", "trail  ", " ", "\r\n a"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)
    some = [50, 200, 30, 187]  # no whole characters
    assert own.decode(np.array(some, np.uint32)) == library.decode(some, skip_special_tokens=False)


def test_pipeline_tokens_take_one_python_worker_a_task(spark, odd, empty):
    both = bpe.decode(bpe.encode(odd)).select("doc_id", "ids", "text")
    assert sorted(map(repr, bpe.encode_decode(odd).collect())) == sorted(map(repr, both.collect()))
    assert bpe.encode_decode(empty).count() == 0
    stage = corpus_pipeline.token_ids(spark, odd, "")
    assert stage._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_op5_and_op9_over_odd_rows(spark, folder, library):
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in TEXTS}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = QUERIES["op5_bpe_encode_decode"](spark, folder).collect()
    want = Counter(
        (i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(library.decode(ids[t], skip_special_tokens=False)))
        for i, t in TEXTS
    )
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    rows = QUERIES["op9_token_files"](spark, folder).collect()
    start, expected = 0, Counter()
    for i, t in sorted(TEXTS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        every = [*ids[t], 0]
        expected[i, start, len(every), zlib.crc32(np.array(every, "<u4").tobytes())] += 1
        start += len(every)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == expected


def test_token_files_layout(spark, odd, empty, tmp_path):
    import pyarrow.parquet as pq

    out = str(tmp_path / "tokens")
    token_files.write(odd, out)
    part = next(p for p in (tmp_path / "tokens").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    meta = pq.ParquetFile(part).metadata.row_group(0)
    encodings = {meta.column(i).path_in_schema: meta.column(i).encodings for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in next(v for k, v in encodings.items() if k.startswith("ids")))
    assert "DELTA_BINARY_PACKED" in encodings["n_tokens"]
    assert all(meta.column(i).has_column_index for i in range(meta.num_columns) if meta.column(i).path_in_schema == "doc_id")
    token_files.write(empty, str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0
    assert bpe.decode(bpe.encode(empty)).count() == 0


# --- personal data -------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            bad = {
                "email": False,
                "ip": any(int(p) > 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": not (12 <= len(d) <= 19 and luhn(d)),
                "phone": not 9 <= len(d) <= 15,
            }[kind]
            if not bad:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_op6_base_spans(make, odd, empty):
    rnd = random.Random(3)
    letters = "0123456789 -.+()@a_%🙂é"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1" * 9000, "a" * 9000, "1.2.3.4 " * 1500, None, ""]
    texts += ["00000000001.2.3.256 0255.1.1.1", "4111 1111 1111 1111 x", "x@y.com" * 50]
    texts += ["Please call 415-555-1234 or Dr. Alice Smith; ssn 123-45-6789"] * 3
    rows = pii.spans(make(list(enumerate(texts)))).select(
        "doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans")
    )
    got = {r.doc_id: r for r in rows.collect()}
    for i, text in enumerate(texts):
        assert got[i].base == brute_spans(text or "")
        assert {*filter(None, got[i].base.split(","))} <= set(got[i].spans.split(","))
    assert "phone:12:24" in got[len(texts) - 1].spans and "ssn:" in got[len(texts) - 1].spans
    assert pii.spans(odd).count() == len(TEXTS) and pii.spans(empty).count() == 0


def test_redact(odd, empty, make):
    out = {r.doc_id: r for r in pii.redact(odd).collect()}
    assert pii.redact(odd).columns == odd.columns and out[4].text is None and out[9]._base == "b"
    assert out[9].text.startswith("mail <email> or <phone>, <ip>, <card> ")
    assert pii.redact(empty).count() == 0


def test_reliabilities_prefer_agreement():
    counts = [(0, (1, 1, 1, 0), True, 80), (3, (1, 1, 0, 0), False, 20), (3, (-1, -1, -1, -1), False, 60)]
    known = pii.reliabilities(counts)
    assert known[0] == pii.KNOWN and known[1] > 0.5 > known[2]


# --- decontamination -----------------------------------------------------------------


@pytest.mark.parametrize("bound", [1_000_000, -1])
def test_op7_templates_and_slots(make, benchmark_items, odd, empty, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    same = "Once more: Carol bought 99 lbs of apples for 7 dollars and gave Dave 99 lbs today"
    docs = make(
        [
            (1, "so Alice bought 12 kg of apples for 30 dollars and gave Bob 12 kg today it says"),
            (2, same),
            (3, same.replace("Dave 99", "Dave 98")),
            (4, "nothing of the sort is in this text at all, it is quite long and quite clean"),
            (5, "quite short"),
            (6, None),
        ]
    )
    got = {r.doc_id: (r.contaminated, r.item_id) for r in decontaminate.contamination(docs, benchmark_items).collect()}
    assert got == {1: (True, 3), 2: (True, 3), 3: (False, None), 4: (False, None), 5: (True, 4), 6: (False, None)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, benchmark_items).collect()) == [3, 4, 6]
    rows = decontaminate.contamination(odd, benchmark_items).collect()
    assert len(rows) == len(TEXTS) and {r.doc_id for r in rows if r.contaminated} == {1, 2}
    assert decontaminate.clean(odd, benchmark_items).columns == odd.columns
    assert decontaminate.contamination(empty, benchmark_items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, benchmark_items.limit(0)).collect())


def _around(text):
    return f"This page opens with words of its own, then {text} and it goes on with others for a while."


SUM = "a farmer keeps several brown cows behind the old wooden barn and sells fresh milk every single morning"


def _found(make, spark, item, copies):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = decontaminate.contamination(make([(i, _around(t)) for i, t in enumerate(copies)]), items).collect()
    return {r.doc_id for r in rows if r.contaminated}


def test_op7_near_copies(make, spark):
    words = SUM.split()
    replaced = [w if k not in (4, 9, 14) else "other" for k, w in enumerate(words)]
    inserted = words[:5] + ["quite"] + words[5:11] + ["very"] + words[11:]
    deleted = words[:6] + words[7:12] + words[13:]
    half = words[:10]
    apart = [w if k % 4 else "other" for k, w in enumerate(words)]
    copies = [" ".join(c) for c in (replaced, inserted, deleted, half, apart)]
    assert _found(make, spark, SUM, copies) == {0, 1, 2}


def test_op7_copies_that_differ_in_case(make, spark):
    item = "a farmer keeps 12 brown cows behind the old wooden barn and sells fresh milk every single morning"
    copies = [item.upper(), item.title(), item.upper().replace("12", "31"), SUM[:50].upper()]
    assert _found(make, spark, item, copies) == {0, 1, 2}


def test_op7_items_of_numbers_and_names(make, spark):
    item = "Compute 12 + 30 * 4 - 7"
    assert _found(make, spark, item, [item, item.replace("30", "31").replace("4", "9"), "compute"]) == {0}
    names = "Alice Brown, Carol Davis, Erin Fox, Grace Hill and Ivan Jones"
    assert _found(make, spark, names, [names, "Tom Gray, Uma Reed, Vera Stone, Will Young and Xena Zane"]) == {0}


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_over_odd_rows(spark, folder, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd.columns, name
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(rows) <= {i for i, _ in TEXTS} and 2 not in rows
    assert all(r.n_tokens == len(r.ids) for r in rows.values())


def test_pipeline_empty(spark, empty, labels, benchmark_items, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark_items.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_matches_brute_force(spark, tmp_path, library, benchmark_items):
    """Every stage restated plainly over planted rows."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n)) + "."
    junk = lambda: " ".join(f"{word().upper()}!!" for _ in range(60))
    docs = {i: prose(6) + "\n" + prose(5) for i in range(60)}
    docs |= {i: junk() + "\n" + junk() for i in range(60, 100)}
    docs[100] = docs[7]
    docs[101] = docs[8].replace(docs[8].split()[20], "changed", 1)
    docs[102] = prose(4) + " the quick brown fox jumps over the lazy dog near the old river " + prose(4)
    docs[103] = prose(5) + " Write to bob@example.com or call +1 212 555 0100 today. " + prose(5)
    quality = {i: int(not 60 <= i < 100) for i in docs}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    benchmark_items.write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {i: t for i, t in docs.items() if quality[i]}
    grams = {}
    for i, t in kept.items():
        w = re.sub(r"[.,;:!?\"'()*#%$&|]", "", t.lower()).split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    first = [i for i in kept if not any(len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) for j in kept if j < i)]
    leaked = "quick brown fox jumps over the lazy dog near the old river"
    clean = {i: kept[i] for i in first if leaked not in kept[i].lower()}
    masked = {i: t.replace("bob@example.com", "<email>").replace("+1 212 555 0100", "<phone>") for i, t in clean.items()}
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in masked.items()}
    got = {r.doc_id: (list(r.ids), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and not {100, 101, 102} & set(got) and 103 in got
    for i, ids in want.items():
        assert got[i] == (ids, len(ids), hashlib.sha256(masked[i].encode()).hexdigest())
