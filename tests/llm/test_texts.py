"""Fingerprints, repeats, quality, near-duplicates and languages against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from catalogforge.llm import common, langid, merkle, neardup, quality, simhash, suffix
from catalogforge.llm.common import components, hot_join
from catalogforge.llm.queries import QUERIES
from tests.llm.conftest import TEXTS


@pytest.fixture(scope="module")
def folder(odd, labels, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def plain(texts):
    return [(i, t or "") for i, t in texts]


# --- helpers -------------------------------------------------------------------------


def test_components_match_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)]
    edges += [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.root for r in found}
    for a, b in edges:
        if a != b:
            assert got.get(a, a) == root(a) and got.get(b, b) == root(b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_links_in_one_task_need_no_rounds(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(300)] + [(-5, 900), (900, 900), (901, 900)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(1, 301)} | {900: -5, 901: -5}
    # Links in many forests meet in rounds.
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        dealt = components(df).collect()
    finally:
        spark.conf.unset(conf)
    assert len(dealt) == len(want) and {r.node: r.root for r in dealt} == want
    monkeypatch.setattr(common, "_star", lambda *a, **b: pytest.fail("a round over a single forest"))
    alone = components(df).collect()
    assert len(alone) == len(want) and {r.node: r.root for r in alone} == want


def test_forests_of_few_links_at_a_time(spark):
    code = common._contracted(spark.createDataFrame([(1, 0), (3, 2), (2, 1)], "u long, v long").coalesce(1))
    assert sorted(tuple(r)[:2] for r in code.collect()) == [(1, 0), (2, 0), (3, 0)]


def test_quality_fit_holds_few_bytes_a_line():
    rnd = np.random.default_rng(1)
    facts = rnd.random((60_000, len(quality.FACTS)))
    first = np.arange(0, 60_000, 20)
    epochs, quality.EPOCHS = quality.EPOCHS, 2
    tracemalloc.start()
    try:
        quality.fit(facts, first, np.arange(len(first)) % 2)
        assert tracemalloc.get_traced_memory()[1] < 60_000 * 900
    finally:
        tracemalloc.stop()
        quality.EPOCHS = epochs


def test_hot_join_keeps_every_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 0").withColumn("v", F.col("k") + 1)
    got = hot_join(rows, table, "k", "n", 3000)
    assert got.columns == ["k", "v"]
    want = Counter((k, k + 1 if k % 2 == 0 else None) for k in [0] * 2000 + list(range(2000, 3000)))
    assert Counter(tuple(r) for r in got.collect()) == want


# --- fingerprints --------------------------------------------------------------------


def test_op1_edits_and_equality(spark, folder):
    rows = QUERIES["op1_document_fingerprints"](spark, folder).collect()
    assert len(rows) == len(TEXTS)
    distinct = sorted(set(plain(TEXTS)), key=lambda d: (d[0] is None, -(d[0] or 0)))
    want = {}
    for k, (i, t) in enumerate(distinct):
        nxt, half = distinct[(k + 1) % len(distinct)][1], len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())
    for r in rows:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[2] and prints[3] == prints[4]
    assert len(set(prints.values())) == len({t for _, t in plain(TEXTS)})


def test_merkle_empty_and_single(empty, make):
    assert merkle.with_next(empty).count() == 0
    one = merkle.with_next(make([(1, "abcd")])).first()
    assert one.edited == "abab" and one.next_fp == one.fp


def test_merkle_locates_edits(spark):
    text = "\n".join(f"Paragraph {i} says this. And also that." for i in range(40))
    other = text.replace("Paragraph 17 says", "Paragraph 17 denies")
    df = spark.createDataFrame([(text, other)], "a string, b string").select(
        merkle.fingerprint("a").alias("x"), merkle.fingerprint("b").alias("y")
    )
    r = df.select(merkle.differing("x", "y").alias("d"), merkle.likeness("x", "y").alias("l")).first()
    assert list(r.d) == [17] and 0.9 < r.l < 1


# --- repeats -------------------------------------------------------------------------


def brute_repeats(docs):
    tie = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=7).digest())
    seen, out = {}, {}
    for i, t in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, tie(d[1]))):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            window = raw[s : s + 100]
            if window in seen:
                gone[s : s + 100] = True
            seen.setdefault(window, True)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i, t] = (len(raw), int(gone.sum()), spans, kept)
    return out


@pytest.mark.parametrize("heavy, size", [(8192, 4 << 20), (2, 20_000)])
def test_op2_matches_brute_force(make, heavy, size):
    rnd = random.Random(4)
    line = "This very common line is shared by many documents and it is longer than one hundred bytes, for sure. "
    noise = lambda n: "".join(rnd.choice("qwertyuiop é") for _ in range(n))
    docs = [(i, noise(60) + line + noise(50)) for i in range(40)]
    docs += [(100, "ab" * 300), (101, "a" * 500), (102, noise(99)), (103, docs[0][1] + docs[1][1])]
    docs += [(104, docs[3][1]), (104, docs[3][1]), (105, None), (106, ""), (None, docs[5][1])]
    docs += [(100, "another text " * 20)]
    got = suffix.remove_repeats(make(docs), heavy=heavy, shard=size, bucket=size).collect()
    want = brute_repeats([(i, t or "") for i, t in docs])
    have = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    assert have == Counter((i, *want[i, t or ""]) for i, t in docs)


def test_suffix_array_and_prefixes():
    rnd = random.Random(5)
    for t in range(30):
        raw = bytes(rnd.choice(b"ab" if t % 3 else b"abcdefgh \x00") for _ in range(rnd.randint(1, 300)))
        raw = raw * (1 + t % 3)
        data = np.frombuffer(raw, np.uint8)
        order = suffix.suffix_array(data, len(raw))
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = suffix.common_prefixes(data, order, len(raw) + 1)
        for n, (a, b) in zip(shared[1:], itertools.pairwise(order), strict=True):
            assert raw[a : a + n] == raw[b : b + n]
            assert max(a, b) + n == len(raw) or raw[a + n] != raw[b + n]


def test_suffix_odd_rows(odd, empty):
    assert suffix.remove_repeats(odd).count() == len(TEXTS)
    assert suffix.remove_repeats(empty).count() == 0


# --- quality -------------------------------------------------------------------------


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        odds, chain = rng.normal(size=n), rng.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(o * b for o, b in zip(odds, y, strict=True)) + sum(chain[a, b] for a, b in itertools.pairwise(y)))
            total += weight
            good += weight * np.array(y)
        assert np.allclose(quality.marginals(odds.tolist(), chain), good / total)
        batch, _ = quality._expect(odds[None], np.ones((1, n), bool), chain)
        assert np.allclose(batch[0], good / total)


def test_op3_learns_from_the_rest_only(make, spark):
    good = "The river runs past the old mill, and people of the town walk there.\nThey talk of the day."
    bad = "BUY!! NOW!! BUY!! NOW!! CHEAP!!\nBUY!! NOW!! BUY!! NOW!! CHEAP!!"
    docs = make([(i, (good if i % 2 else bad) + f" {i}") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(held) > 50 and np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_quality_odd_rows(odd, empty, labels):
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(TEXTS)


# --- near-duplicates -----------------------------------------------------------------


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, radius):
    up = list(range(len(values)))
    for _ in values:
        new = [min(up[j] for j, y in enumerate(values) if (x ^ y).bit_count() <= radius) for x in values]
        if new == up:
            return up
        up = new
    return up


def test_op8_matches_brute_force(spark, folder):
    rows = QUERIES["op8_simhash_near_dedup"](spark, folder).collect()
    fps = [brute_fingerprint(t) for _, t in plain(TEXTS)]
    groups = brute_groups(fps, 2)
    first = {g: min((i for (i, _), h in zip(TEXTS, groups, strict=True) if h == g and i is not None), default=None) for g in groups}
    want = Counter((i, f"{f:016x}", first[g]) for (i, _), f, g in zip(TEXTS, fps, groups, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_tree_loses_no_link(spark, monkeypatch):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(60)]
    values = set(centres)
    for c in centres:
        for _ in range(60):
            values.add(c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    values = np.array(sorted(values), np.uint64)
    monkeypatch.setattr(simhash, "LEAF", 128)
    frame = pd.DataFrame({"fp": values.view(np.int64)})
    links = simhash.linked(spark.createDataFrame(frame)).collect()
    up = {v: v for v in frame.fp}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        a, b = sorted((root(r.a), root(r.b)))
        up[b] = a
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    labels = np.arange(len(values))
    while not np.array_equal(new := np.array([labels[row].min() for row in near]), labels):
        labels = new
    got = {}
    for v, label in zip(frame.fp, labels, strict=True):
        got.setdefault(root(v), set()).add(label)
    assert all(len(s) == 1 for s in got.values()) and len(got) == len(set(labels.tolist()))


def test_one_of_each_group_stays(make, odd, empty):
    rnd = random.Random(6)
    words = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    docs = [(i, " ".join(words(80))) for i in range(30)]
    base = words(200)
    near = base[:]
    near[100] = "changed"
    docs += [(50, " ".join(base)), (51, " ".join(near)), (52, " ".join(base)), (52, " ".join(base))]
    docs += [(60, " ".join(base[:100] + words(100)))]
    kept = [r.doc_id for r in neardup.deduplicate(make(docs)).collect()]
    assert sorted(kept) == [*range(30), 50, 60]
    out = neardup.deduplicate(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect()]
    assert 2 not in ids and 4 not in ids and {1, 3, 5, 6}.issubset(ids)
    assert neardup.deduplicate(empty).count() == 0


def test_members_of_a_band_meet_until_tied(spark):
    """One band of 60, in which links other than those of 37 and one far pair would be wrong."""
    rows = [(i, [7] * neardup.BANDS, bytes(4 * neardup.PLACES)) for i in range(60)]
    nodes = spark.createDataFrame(rows, "node long, bands array<long>, places binary")
    nodes = nodes.withColumn("bands", F.slice("bands", 1, 1))
    known = spark.createDataFrame([], "a long, b long")
    only = "(a = 37 or b = 37) and least(a, b) >= 2 or least(a, b) = 0 and greatest(a, b) = 1"
    got = neardup._joined(nodes, known, lambda pairs: pairs.filter(only)).collect()
    assert {r.node: r.root for r in got if r.node != r.root} == {1: 0} | {i: 2 for i in range(3, 60)}


@pytest.mark.parametrize("place", [0, 30])
def test_loose_copies_reach_their_original(make, place):
    """Copies that are close to one original only, which is no early member of its bands."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(60):
        copy = base[:]
        for k in range(5):
            copy[rnd.randrange(60 * k + 5, 60 * k + 55)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts.insert(place, " ".join(base))
    assert [r.doc_id for r in neardup.deduplicate(make(list(enumerate(texts)))).collect()] == [0]


def test_pairs_are_decided_by_their_shingles(make):
    """Pairs around the limit: exactly those at 0.8 or more lose their second text."""
    rnd = random.Random(9)
    docs, want = [], set()
    for i in range(40):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(204)]
        copy = base[:]
        for k in range(4 + i % 2):
            copy[20 + 40 * k] = "changed"
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        # Shingles that differ: 20 of 200 on each side (0.818), or 25 (0.778).
        want |= {2 * i} if i % 2 == 0 else {2 * i, 2 * i + 1}
    assert {r.doc_id for r in neardup.deduplicate(make(docs)).collect()} == want


# --- languages -----------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba"]
    table = np.concatenate([np.random.default_rng(2).random((len(pieces), 2)) / 9, [[1e-8] * 2, [0, 0]]])
    scorer = langid.Scorer(pieces, table)
    for word in ("ab", "aba", "xab", "abab"):
        marked, total = "▁" + word, np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
            p = np.ones(2)
            for a, b in itertools.pairwise(edges):
                at = scorer.lattice.number.get(marked[a:b])
                p = p * (table[at] if at is not None else (1e-8 if b - a == 1 else 0.0))
            total += p
        scorer.learn({word})
        assert np.allclose(scorer.blocks[scorer.place[word]], np.log(total))
        assert np.allclose(scorer.long(marked), np.log(total))


def test_op10_held_out_accuracy(spark):
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und in den von zu das mit sich".split()}
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices(words[lang], k=12)), lang) for i, lang in enumerate(["en", "de"] * 100)]
    docs = spark.createDataFrame([*rows, (900, "123 !!", "en"), (901, None, "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und"


def test_languages_odd_rows(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_are_learned_from_runs_without_blanks(make, spark):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        lang = "ab"[i % 2]
        letters = "kilometru" if lang == "a" else "wszystkoć"
        rows.append((i, "".join(rnd.choice(letters) for _ in range(200)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def test_quality_sample_keeps_to_its_budget_of_lines(make, spark):
    docs = make([(i, "good line\n" * (3 if i % 2 else 40)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda facts, first, marks: seen.append(len(facts)) or fit(facts, first, marks)
    try:
        quality.learn(docs, labels, budget=100)
        quality.learn(docs, labels)
    finally:
        quality.fit = fit
    assert 0 < seen[0] <= 100 < seen[1]


def test_near_copies_of_one_text_meet_few_others(spark):
    """All pairs that are alike and not tied yet, and hardly any other of a dense group."""
    rnd = random.Random(5)
    base, fresh = set(range(120)), iter(range(1000, 10**6))
    sets = {0: base}
    for i in range(1, 241):
        kin = sets[rnd.randrange(i)] if i % 3 == 0 else base
        lost = set(rnd.sample(sorted(kin), rnd.randrange(4 if i % 3 == 0 else 40)))
        sets[i] = (kin - lost) | {next(fresh) for _ in range(rnd.randrange(len(lost) + 3))}

    def alike(x, y):
        return len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])

    roots = {i: 0 if alike(0, i) else i for i in sets}
    around = spark.createDataFrame([(0, i, r) for i, r in roots.items()], "centre long, node long, root long")
    grams = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, grams array<long>")
    got = {(r.a, r.b) for r in neardup._proposed(around, grams, 0.8).collect()}
    apart = {(x, y) for x in sets for y in sets if x < y and roots[x] != roots[y]}
    want = {(x, y) for x, y in apart if alike(x, y)}
    assert len(want) > 20 and want <= got <= apart
    assert len(got) < len(apart) / 20


def test_neardup_fetches_texts_without_sorting_them(spark, monkeypatch):
    """Texts meet their nodes in a hash join; rows that occur twice still give one row a node."""
    plans, stage = [], neardup.stage

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(neardup, "stage", seen)
    texts = [(1, "a", "one two"), (2, "b", "three"), (1, "a", "one two")]
    rows = spark.createDataFrame(texts, "doc_id long, th string, text string")
    nodes = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "doc_id long, th string, node long")
    got = neardup._grams(nodes.select("node"), nodes, rows, True).collect()
    assert sorted((r.node, len(r.grams)) for r in got) == [(1, 1), (2, 1)]
    once = neardup._grams(nodes.select("node"), nodes, rows.distinct(), False).collect()
    assert sorted(once) == sorted(got)
    last = plans[-1]
    assert "ShuffledHashJoin" in last and "SortAggregate" not in last
