"""Benchmark decontamination by templates: typed placeholders, a hash join, slot checks.

Texts become word sequences in which numbers, names and units are placeholders. Windows
of eight such words are hashed, and windows of documents meet those of benchmark items in
a hash join (then compared in full). Along one alignment of a document with an item, what
fills the placeholders must correspond: one filler of the item always stands against the
same filler of the document. Alignments that fail are dropped; an item counts as leaked
where windows left cover ``COVERAGE`` of its words. So questions with other numbers or
names are found, and chance template matches are not. Near copies are found by windows of a
few words, around which the longest common subsequence of words is taken and held to
``COVERAGE``; placeholders in it must correspond as well.

Everything is SQL functions. Each document is templated once, and all its windows of either
sort meet the hashes of the benchmark's in one join. Only those hashes are broadcast, eight
bytes each, while there are ``BROADCAST_WINDOWS`` of them at most; beyond that the same join
shuffles. A text is held whole by the task that reads it, at some 100 bytes a word.

Defined cases: null texts count as empty and leak nothing; an item of fewer words than a
window is one window of its own length; matches of placeholders with fewer than
``LITERALS`` plain words (or than their length, if shorter) are no evidence unless every word
is the same, so exact copies of items of numbers and names count; an item that repeats under one id
counts once, under several ids under each; rows equal in ``doc_id`` and text get the same
result; an empty benchmark leaks nothing; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge.llm.common import texts
from catalogforge.session import stage

WINDOW = 8
LITERALS = 3
COVERAGE = 0.8
BROADCAST_WINDOWS = 1_000_000

# Fixed: words that are units where they follow a number or close it.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres"
    " mg g kg lb lbs oz ton tons gram grams pound pounds ounce ounces ml l liter liters litre litres"
    " s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " usd eur dollar dollars cent cents euro euros percent degrees mph kmh"
).split()

_WORD = r"[\p{L}\p{N}].*+"
_TRAILING = ".,;:!?\"')]}|*#%$&"
NUM, NAME, UNIT, NUM_UNIT = "<num>", "<name>", "<unit>", "<num><unit>"

# Word sequences compared for near copies, and the placeholders that each keeps.
FORMS = {"canon": (NUM, NUM_UNIT, UNIT, NAME), "caseless": (NUM, NUM_UNIT, UNIT), "literal": ()}


def words(text: Column) -> Column:
    """Runs of non-blanks from their first letter or digit on; blanks are single spaces."""
    ascii_start = lambda t: ((t >= "a") & (t < "{")) | ((t >= "0") & (t < ":")) | ((t >= "A") & (t < "["))
    cut = F.transform(
        F.split(text, " "), lambda t: F.when(ascii_start(t), t).otherwise(F.regexp_extract(t, f"(?s){_WORD}", 0))
    )
    return F.filter(cut, lambda t: t != "")


def _spaced(text: Column) -> Column:
    """The text with every blank as a space."""
    for blank in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def templated(rows: DataFrame) -> DataFrame:
    """``rows`` with ``low`` and ``canon`` in place of ``text``: its words without trailing
    punctuation, lower-cased, and the same with typed placeholders.

    A capitalised word is a name unless it opens the text or a sentence.
    """
    unit = "|".join(UNITS)

    def canonical(split: Column, low: Column, core: Column, i: Column) -> Column:
        lower = F.get(low, i)
        before = F.get(split["word"], i - 1)
        number = (
            F.when(core.rlike(r"^[0-9][0-9.,:/-]*+$"), NUM)
            .when(lower.rlike(rf"^[0-9][0-9.,]*+(?:{unit})$"), NUM_UNIT)
            .otherwise(lower)
        )
        after_number = F.coalesce((before >= "0") & (before < ":"), F.lit(False))
        inside = F.coalesce(~F.right(before, F.lit(1)).isin(".", "!", "?"), F.lit(False))
        return (
            F.when((core >= "0") & (core < ":"), number)
            .when(lower.isin(UNITS) & after_number, UNIT)
            .when((core >= "A") & (core < "[") & inside, NAME)
            .otherwise(lower)
        )

    def shaped(split: Column, low: Column) -> Column:
        canon = F.transform(split["core"], lambda core, i: canonical(split, low, core, i))
        return F.struct(low.alias("low"), canon.alias("canon"))

    # Bound as variables, so that looking at a neighbour does not split the text again.
    cores = lambda w: F.transform(w, lambda x: F.rtrim(x, F.lit(_TRAILING)))
    one = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    lowered = lambda s: one(F.transform(s["core"], F.lower), lambda low: shaped(s, low))
    bound = F.transform(
        F.array(words(F.col("text"))),
        lambda w: one(F.struct(w.alias("word"), cores(w).alias("core")), lowered),
    )
    kept = [c for c in rows.columns if c != "text"]
    spaced = rows.select(*kept, _spaced(F.col("text")).alias("text"))
    return spaced.select(*kept, F.get(bound, F.lit(0)).alias("both")).select(*kept, "both.low", "both.canon")


def _hash(sign: int, of: Column, start: Column, n: int) -> Column:
    """A hash of ``n`` words of an array; the sign tells template windows (+) from seeds (-)."""
    return F.xxhash64(F.lit(sign * n), _chain([F.get(of, start + i) for i in range(n)]))


def _chain(words: list[Column], head: Column | None = None) -> Column:
    """A hash of words that goes on from the hash of those before them."""
    for word in words:
        head = F.xxhash64(word) if head is None else F.xxhash64(head, word)
    return head


def _hash_all(sign: int, of: Column) -> Column:
    """``_hash`` of a whole array of one to ``WINDOW`` words."""
    size, chosen = F.size(of), F
    for n in range(1, WINDOW + 1):
        chosen = chosen.when(size == n, _hash(sign, of, F.lit(0), n))
    return chosen


def _probes(rows: DataFrame, windows: list[int], seeds: list[int]) -> DataFrame:
    """``templated`` rows to ``key, pos, h``: a row for each window of the lengths given.

    Seeds are taken from the templates and with names left as words. As plain words they can
    differ from the latter only in a first word that is a unit.
    """
    plain = F.transform("canon", lambda c, i: F.when(c == NAME, F.get("low", i)).otherwise(c))
    # Outer, as Spark would work the words out once more to filter rows before a plain one.
    places = F.explode_outer(F.when(F.size("canon") > 0, F.sequence(F.lit(0), F.size("canon") - 1)))
    spread = rows.withColumn("plain", plain).withColumn("pos", places)
    pos, left = F.col("pos"), F.size("canon") - F.col("pos")
    hashes, held = [], {"canon": 0, "plain": 0}
    lengths = {"canon": sorted({*windows, *seeds}), "plain": sorted(seeds)}
    for form, sizes in lengths.items():
        for n in sizes:
            # The hash of the shorter window goes on to the longer one.
            inside = [F.get(form, pos + i) for i in range(held[form], n)]
            before = F.col(f"{form}{held[form]}") if held[form] else None
            spread = spread.withColumn(f"{form}{n}", _chain(inside, before))
            held[form] = n
            for sign, wanted in ((1, windows if form == "canon" else []), (-1, seeds)):
                if n in wanted:
                    hashes.append(F.when(left >= n, F.xxhash64(F.lit(sign * n), F.col(f"{form}{n}"))))
    opens = F.get("low", pos).isin(UNITS)
    hashes += [F.when((left >= n) & opens, _hash(-1, F.col("low"), pos, n)) for n in seeds]
    none = F.array().cast("array<bigint>")
    every = spread.select("key", "pos", F.explode_outer(F.array(*hashes) if hashes else none).alias("h"))
    return every.filter(F.col("h").isNotNull())


def _filled(rows: DataFrame) -> DataFrame:
    """A row for each of ``spots`` (pos, len) of the words: ``w_text``, and ``w_slots``, what
    fills the placeholders, as ``kind=filler`` in order."""

    def of(both: Column, spot: Column) -> Column:
        c = F.slice(both["c"], spot["pos"] + 1, spot["len"])
        w = F.slice(both["w"], spot["pos"] + 1, spot["len"])
        filler = F.zip_with(c, w, lambda k, x: F.when(k.startswith("<"), F.concat(k, F.lit("="), x)))
        return F.struct(
            spot["pos"].alias("pos"),
            spot["len"].alias("len"),
            F.array_join(c, " ").alias("w_text"),
            F.filter(filler, lambda x: x.isNotNull()).alias("w_slots"),
            F.size(F.filter(c, lambda x: ~x.startswith("<"))).alias("w_plain"),
        )

    both = F.array(F.struct(F.col("canon").alias("c"), F.col("low").alias("w")))
    bound = F.transform(both, lambda b: F.transform("spots", lambda s: of(b, s)))
    kept = [c for c in rows.columns if c not in ("low", "canon", "spots")]
    narrow = rows.select(*kept, F.get(bound, F.lit(0)).alias("found"))
    return narrow.select(*kept, F.explode_outer("found").alias("f")).select(*kept, "f.*")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of the items: ``h, item_id, item, n, i_pos, len, i_text, i_slots``."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.xxhash64("text").alias("item"),
    ).distinct()
    length = F.least(F.size("canon"), F.lit(WINDOW))
    spots = F.transform(
        F.sequence(F.lit(0), F.size("canon") - length),
        lambda i: F.struct(i.alias("pos"), length.alias("len")),
    )
    canon = templated(items).withColumn("n", F.size("canon")).filter("n > 0")
    every = _filled(canon.withColumn("spots", spots))
    kept = every.filter(F.col("w_plain") >= F.least(F.lit(LITERALS), F.col("len")))
    hashed = _hash_all(1, F.split("w_text", " "))
    return kept.select(
        hashed.alias("h"), "item_id", "item", "n", F.col("pos").alias("i_pos"), "len",
        F.col("w_text").alias("i_text"), F.col("w_slots").alias("i_slots"),
    )


def _forms(rows: DataFrame) -> DataFrame:
    """``templated`` rows with ``forms``, the word sequences in which copies may agree, in
    place of ``canon``."""
    made = []
    for name, kept in FORMS.items():
        same = F.zip_with("canon", "low", lambda c, w: F.when(c.isin(*kept), c).otherwise(w) if kept else w)  # noqa: B023
        made.append(F.col("canon") if name == "canon" else same)
    return rows.withColumn("forms", F.array(*made)).drop("canon")


def _seeds(items: DataFrame) -> DataFrame:
    """``item, n, i_pos, len, h``: each window of ``len`` words of each form."""
    last = F.size("low") - F.col("len")
    spread = items.withColumn("i_pos", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))))
    cut = [F.slice(F.get("forms", F.lit(k)), F.col("i_pos") + 1, F.col("len")) for k in range(len(FORMS))]
    hashed = F.array_distinct(F.array(*[_hash_all(-1, c) for c in cut]))
    return spread.select("item", "n", "i_pos", "len", F.explode_outer(hashed).alias("h")).distinct()


def _aligned(a: Column, b: Column, fill_a: Column, fill_b: Column) -> Column:
    """The longest common subsequence of two word arrays, as ``same`` (its words) and
    ``pairs`` (what fills each placeholder of it, on either side).

    Step by step over ``a``, element k holds the least end in ``b`` of k common words.
    """
    none = F.lit(2**31 - 1)
    pairs = F.array().cast("array<struct<a:string,b:string>>")
    first = F.struct(F.lit(-1).alias("end"), pairs.alias("pairs"))
    further = F.struct(none.alias("end"), pairs.alias("pairs"))
    places = F.transform(b, lambda w, at: F.struct(w.alias("w"), at.cast("int").alias("at")))

    def step(ends: Column, x: Column) -> Column:
        met = F.transform(F.filter(places, lambda y: y["w"] == x["w"]), lambda y: y["at"])

        def longer(now: Column, k: Column, met: Column) -> Column:
            before = F.get(ends, k - 1)

            def to(at: Column) -> Column:
                slot = F.struct(F.concat(x["w"], x["fill"]).alias("a"), F.get(fill_b, at).alias("b"))
                held = F.when(x["w"].startswith("<"), F.concat(before["pairs"], F.array(slot))).otherwise(before["pairs"])
                return F.when((k > 0) & (at < now["end"]), F.struct(at.alias("end"), held.alias("pairs"))).otherwise(now)

            at = F.array_min(F.filter(met, lambda y: y > before["end"]))
            return F.get(F.transform(F.array(at), to), F.lit(0))

        # Bound as variables, so that they are worked out once a step and element.
        more = F.concat(ends, F.array(further))
        every = F.transform(F.array(met), lambda m: F.transform(more, lambda now, k: longer(now, k, m)))
        reached = F.filter(F.get(every, F.lit(0)), lambda e: e["end"] < none)
        return F.when(F.array_contains(b, x["w"]), reached).otherwise(ends)

    steps = F.zip_with(a, fill_a, lambda w, f: F.struct(w.alias("w"), f.alias("fill")))
    reached = F.aggregate(steps, F.array(first), step)
    return F.transform(
        F.array(reached), lambda r: F.struct((F.size(r) - 1).alias("same"), F.get(r, F.size(r) - 1)["pairs"].alias("pairs"))
    )[0]


def _benchmark_words(benchmark: DataFrame) -> DataFrame:
    """``item_id, low, forms, n, item`` of the items that have words."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).distinct()
    item_words = _forms(templated(items)).withColumn("n", F.size("low")).filter("n > 0")
    return item_words.withColumn("item", F.xxhash64("item_id", "low"))


def benchmark_seeds(item_words: DataFrame, coverage: float) -> DataFrame:
    """``_seeds`` so short that an item with as many words replaced or left out as
    ``coverage`` allows has one intact."""
    changed = F.floor(F.col("n") * F.lit(1 - coverage) + F.lit(1e-9))
    length = F.least(F.ceil((F.col("n") - changed) / (changed + 1)), F.lit(WINDOW)).cast("int")
    return _seeds(item_words.withColumn("len", length))


def _near_copies(rows: DataFrame, hits: DataFrame, item_words: DataFrame, seeds: DataFrame, coverage: float) -> DataFrame:
    """``key, item_id, coverage``: items of which ``coverage`` of the words stand in a document
    in their order, within a quarter of the item's length around a shared seed."""
    met = hits.join(seeds, "h")
    lines = met.select("key", "item", "n", (F.col("pos") - F.col("i_pos")).alias("line")).distinct()
    spots = lines.groupBy("key").agg(F.collect_list(F.struct("item", "n", "line")).alias("spots"))
    # The words around a line: the item's length, and a quarter of it on either side.
    found = _forms(templated(rows.join(stage(spots, "near-lines"), "key")))
    slack = lambda s: F.greatest(F.lit(1), F.floor(s["n"] / 4)).cast("int")
    begin = lambda s: F.greatest(F.lit(0), s["line"] - slack(s))
    cut = lambda words, s: F.slice(words, begin(s) + 1, s["line"] + s["n"] + slack(s) - begin(s))
    # Bound as a variable, so that a line does not work the words out again.
    bound = F.array(F.struct("low", "forms"))
    around = F.transform(
        bound,
        lambda w: F.transform(
            "spots",
            lambda s: F.struct(
                s["item"].alias("item"), cut(w["low"], s).alias("d_low"),
                F.transform(w["forms"], lambda f: cut(f, s)).alias("d_forms"),
            ),
        ),
    )
    around = found.select("key", F.get(around, F.lit(0)).alias("around"))
    around = stage(around.select("key", F.explode_outer("around").alias("r")).select("key", "r.*"), "near-around")
    both = around.distinct().join(item_words, "item")
    each = both.select(
        "key", "item_id", "n", "low", "d_low",
        F.explode_outer(F.array_distinct(F.arrays_zip(F.col("forms").alias("i"), F.col("d_forms").alias("d")))).alias("f"),
    ).select("key", "item_id", "n", "low", "d_low", F.col("f.i").alias("i"), F.col("f.d").alias("d"))
    # As many words at least as can agree in any order.
    held = F.size(F.filter("i", lambda w: F.array_contains(F.col("d"), w)))
    each = stage(each.filter(held >= F.col("n") * F.lit(coverage) - 1e-9), "near-places")
    judged = each.withColumn("best", _aligned(*map(F.col, ("i", "d", "low", "d_low")))).select("key", "item_id", "n", "best.*")
    fillers = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    plain = F.col("same") - F.size("pairs")
    evident = (F.size("pairs") == 0) | (
        (plain >= F.least(F.lit(LITERALS), F.col("n"))) & (plain * WINDOW >= F.col("same") * LITERALS)
    )
    fair = judged.filter(evident & (fillers == F.size(F.array_distinct("pairs"))))
    share = fair.groupBy("key", "item_id").agg(F.max(F.col("same") / F.col("n")).alias("coverage"))
    return share.filter(F.col("coverage") >= F.lit(coverage))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``key, item_id, coverage``: items leaked into documents; ``key`` as ``document_key``."""
    windows = stage(benchmark_windows(benchmark), "benchmark-windows")
    item_words = stage(_benchmark_words(benchmark), "benchmark-words")
    seeds = stage(benchmark_seeds(item_words, coverage), "benchmark-seeds")
    lengths = [sorted(x.agg(F.collect_set("len")).first()[0]) for x in (windows, seeds)]
    known = stage(windows.select("h").union(seeds.select("h")).distinct(), "benchmark-hashes")
    small = F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known
    rows = texts(docs).select(document_key().alias("key"), "text")
    hits = stage(_probes(templated(rows), *lengths).join(small, "h"), "leak-hits")
    whole = _template_leaks(rows, hits, windows, coverage)
    every = whole.unionByName(_near_copies(rows, hits, item_words, seeds, coverage))
    return every.groupBy("key", "item_id").agg(F.max("coverage").alias("coverage"))


def _template_leaks(rows: DataFrame, hits: DataFrame, windows: DataFrame, coverage: float) -> DataFrame:
    """``key, item_id, coverage``: items whose intact template windows cover ``coverage``."""
    met = stage(hits.join(windows, "h"), "leak-windows")
    # The words of a document are worked out again where it has matches, once for all of them.
    spots = met.groupBy("key").agg(F.collect_set(F.struct("pos", "len")).alias("spots"))
    filled = _filled(templated(rows.join(spots, "key"))).distinct()
    met = met.join(filled, ["key", "pos", "len"]).filter(F.col("w_text") == F.col("i_text"))
    pairs = F.zip_with("i_slots", "w_slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    lined = met.select(
        "key", "item_id", "item", "n", (F.col("pos") - F.col("i_pos")).alias("line"),
        F.struct("i_pos", "len").alias("at"), pairs.alias("pairs"),
    )
    # Both sets are bounded by the length of the item.
    line = lined.groupBy("key", "item_id", "item", "n", "line").agg(
        F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    fillers = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    fair = line.filter(fillers == F.size("pairs"))
    covered = F.flatten(
        F.transform(
            F.flatten(F.collect_set("ats")),
            lambda x: F.sequence(x["i_pos"], x["i_pos"] + x["len"] - 1),
        )
    )
    share = F.size(F.array_distinct(covered)) / F.col("n")
    whole = fair.groupBy("key", "item_id", "item", "n").agg(share.alias("coverage"))
    return (
        whole.filter(F.col("coverage") >= coverage)
        .groupBy("key", "item_id")
        .agg(F.max("coverage").alias("coverage"))
    )


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A hash that tells documents apart, also those of one id."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, contaminated, n_items, item_id, coverage`` of every row of ``docs``.

    ``item_id`` is the item covered most (the smallest of equals), null in clean rows.
    """
    best = F.struct(-F.col("coverage"), "item_id")
    found = stage(
        leaks(docs, benchmark, coverage)
        .groupBy("key")
        .agg(
            F.count("*").alias("n_items"),
            F.min(best).getField("item_id").alias("item_id"),
            F.max("coverage").alias("coverage"),
        ),
        "leaks",
    )
    rows = texts(docs).select("doc_id", document_key().alias("key"))
    return rows.join(found, "key", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        "item_id",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, into which no item has leaked."""
    found = stage(leaks(docs, benchmark, coverage).select("key").distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), document_key().alias("key"))
    return rows.join(found, "key", "left_anti").select("row.*")
