"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and
a span classifier is trained on what they agree on.

Four fixed patterns with checks give the base spans, which always stay. A wider pattern
proposes further spans (national phone numbers, identity numbers, titled names, spelled-out
addresses). Labelers of four sorts (pattern, gazetteer, context, shape) vote on every span.
Votes are counted by combination, of which there are few at any size of input;
expectation-maximisation over those counts estimates how reliable each labeler is, and a
logistic classifier over votes, kind and length is fitted to its posteriors. Proposed
spans that it accepts and that touch no base span are added.

Everything is SQL functions; the driver fits on the counts alone. Positions come from the
lengths of the pieces between matches, in running sums by blocks, so long texts with very
many matches stay near linear.

Defined cases: null texts count as empty and have no span; documents that repeat get a row
each; without any span nothing is fitted and nothing added; an empty table gives an empty
result; further columns are ignored by ``spans`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge.session import stage

KINDS = ("email", "ip", "card", "phone", "ssn", "name")
EMAIL, IP, CARD, PHONE, SSN, NAME = range(len(KINDS))

# The base patterns, written so that long runs are not tried again from each character: a
# match starts where the last ended or where a run of its first class begins.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    EMAIL: rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?+[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = (
    r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?"
    r"|[A-Za-z0-9._+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,10})"
    r"(?![0-9A-Za-z])"
)
CONTEXT = 32
BLOCK = 256
ACCEPT = 0.5

# Fixed word lists of the gazetteer and context labelers.
DOMAINS = "com org net edu gov io co info de fr es uk eu us example".split()
GIVEN = (
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara"
    " richard susan joseph jessica thomas sarah anna maria peter paul hans claire pierre jose"
    " carlos lucia alice bob carol dave".split()
)
CUES = {
    EMAIL: "mail|contact|write|reach|address",
    IP: r"\bip\b|host|server|address|login|from",
    CARD: "card|visa|amex|master|pay|account|credit",
    PHONE: r"phone|call|tel\b|fax|mobile|contact|dial",
    SSN: "ssn|social|security|identity",
    NAME: "dear|name|by|from|contact|signed",
}
AGAINST = r"version|isbn|invoice|order|page|total|figure|release|build|serial"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """The sum of the entries before each one, in blocks."""

    def sums(values: Column) -> Column:
        empty = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(
            values,
            empty,
            lambda acc, x: F.struct(
                (acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")
            ),
        )

    def blocks(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
        cut = F.transform(
            F.sequence(F.lit(0), last), lambda i: sums(F.slice(values, i * BLOCK + 1, BLOCK))
        )
        return let(
            cut,
            lambda parts: F.flatten(
                F.zip_with(
                    parts,
                    sums(F.transform(parts, lambda p: p["s"]))["a"],
                    lambda p, base: F.transform(p["a"], lambda x: x + base),
                )
            ),
        )

    return let(sizes, blocks)


_SPAN = "array<struct<start:int,kind:int,end:int,value:string,before:string>>"


def matches(text: Column, pattern: str, kind: Callable[[Column], Column]) -> Column:
    """The matches in order with their code points, and the end of the text before them."""

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return let(
            gaps,
            lambda g: let(
                running(F.zip_with(found, F.slice(g, 1, F.size(found)), lambda m, x: F.length(m) + F.length(x))),
                lambda at: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(at, i) + F.length(F.get(g, i))).alias("start"),
                        kind(m).cast("int").alias("kind"),
                        (F.get(at, i) + F.length(F.get(g, i)) + F.length(m)).alias("end"),
                        m.alias("value"),
                        F.right(F.get(g, i), F.lit(CONTEXT)).alias("before"),
                    ),
                ),
            ),
        )

    nothing = F.array().cast(_SPAN)
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(every, lambda found: F.when(F.size(found) == 0, nothing).otherwise(placed(found)))


def digits(value: Column) -> Column:
    return F.translate(value, " ().-+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def digit(i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(1), F.length(number))
    return F.aggregate(places, F.lit(0), lambda s, i: s + digit(i)) % 10 == 0


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        number = F.ltrim(part, F.lit("0"))
        return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))

    return F.forall(F.split(value, r"\."), small)


def base(text: Column) -> Column:
    """The base spans that pass their checks, by kind and start."""

    def of(kind: int, check: Callable[[Column], Column] | None) -> Column:
        found = matches(text, BASE[kind], lambda m: F.lit(kind))
        return found if check is None else F.filter(found, lambda s: check(s["value"]))

    def card(value: Column) -> Column:
        return let(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))

    return F.concat(
        of(EMAIL, None),
        of(IP, _octets),
        of(CARD, card),
        of(PHONE, lambda v: F.length(digits(v)).between(9, 15)),
    )


def proposed(text: Column) -> Column:
    """Further spans to be judged."""

    def kind(value: Column) -> Column:
        return (
            F.when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), SSN)
            .when(value.rlike(r"\[at\]|\(at\)"), EMAIL)
            .when(value.rlike("^[0-9(]"), PHONE)
            .otherwise(NAME)
        )

    return matches(text, PROPOSED, kind)


# --- labelers ------------------------------------------------------------------------

LABELERS = ("pattern", "gazetteer", "context", "shape")
# How surely a base span is personal.
KNOWN = 0.98


def _yes_no(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1)


def votes(span: Column, strict: bool) -> Column:
    """One vote of each labeler: 1 for, -1 against, 0 abstaining."""
    kind, value, before = span["kind"], span["value"], F.lower(span["before"])
    number = digits(value)
    low = F.lower(value)
    ends = F.regexp_extract(low, r"([a-z]+)$", 1)
    gazetteer = (
        F.when(kind == EMAIL, _yes_no(ends.isin(DOMAINS)))
        .when(kind == IP, F.when(value.rlike(r"^(0|22[4-9]|23\d|24\d|25\d)\."), -1).otherwise(0))
        .when(kind == CARD, _yes_no(number.rlike("^[3-6]")))
        .when(kind == SSN, _yes_no(~number.rlike("^(000|666|9)|^...00|0000$")))
        .when(kind == NAME, F.when(F.exists(F.split(low, " "), lambda w: w.isin(GIVEN)), 1).otherwise(0))
        .otherwise(
            F.when(value.startswith("+"), F.when(number.rlike("^(1|7|3[0-9]|4[0-9])"), 1).otherwise(0))
            .otherwise(_yes_no(number.rlike("^[2-9]..[2-9]")))
        )
    )
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & before.rlike(words))
    context = F.when(before.rlike(AGAINST), -1).when(cue, 1).otherwise(0)
    kinds = F.length(number) - F.length(F.regexp_replace(number, r"(.)(?=.*\1)", ""))
    varied = F.length(number) - kinds
    shape = F.when(kind.isin(EMAIL, NAME), 0).when(varied <= 2, -1).when(varied >= 5, 1).otherwise(0)
    # Loose shapes count where they are whole: both names given, one separator throughout.
    whole = F.when(kind == NAME, _yes_no(F.size(F.split(value, " ")) > 2)).otherwise(
        F.when((kind != PHONE) | value.rlike(r"^\(|^.{3}([ .-]).{3}\1"), 1).otherwise(0)
    )
    pattern = F.lit(1) if strict else whole
    return F.struct(
        pattern.cast("int").alias("pattern"),
        gazetteer.cast("int").alias("gazetteer"),
        context.cast("int").alias("context"),
        shape.cast("int").alias("shape"),
    )


def judged(spans: Column, strict: bool) -> Column:
    """Spans without their texts, with votes and a length class."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.least(F.floor(F.length(s["value"]) / 6), F.lit(4)).cast("int").alias("size"),
            votes(s, strict).alias("votes"),
        ),
    )


# --- reliabilities and classifier, on the driver over counts of combinations -----------


def reliabilities(counts: list[tuple[int, tuple[int, ...], bool, int]], rounds: int = 30) -> list[float]:
    """The posterior of each (kind, votes, base, count), by expectation-maximisation.

    Base spans are known to be personal, up to ``KNOWN``; the others are estimated. The
    share of a kind leans on the share of all.
    """
    after = [KNOWN if base else 1 / (1 + math.exp(-sum(v))) for _, v, base, _ in counts]
    total = sum(n for *_, n in counts)
    for _ in range(rounds):
        share = sum(p * c[-1] for c, p in zip(counts, after, strict=True)) / total
        lean = 0.2 * total / len(KINDS) + 1
        prior = [[lean * (1 - share) + 0.5, lean * share + 0.5] for _ in KINDS]
        # A labeler is taken to be better than chance before anything is seen.
        table = [[[2.0 + 0.05 * total, 1.0, 1.0], [1.0, 1.0, 2.0 + 0.05 * total]] for _ in LABELERS]
        for (kind, vote, _, n), p in zip(counts, after, strict=True):
            for z, weight in ((1, p * n), (0, (1 - p) * n)):
                prior[kind][z] += weight
                for labeler, v in zip(table, vote, strict=True):
                    labeler[z][v + 1] += weight
        fresh = []
        for kind, vote, base, _ in counts:
            odds = math.log(prior[kind][1] / prior[kind][0])
            for labeler, v in zip(table, vote, strict=True):
                if v:
                    odds += math.log(labeler[1][v + 1] / sum(labeler[1]))
                    odds -= math.log(labeler[0][v + 1] / sum(labeler[0]))
            fresh.append(KNOWN if base else 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        after = fresh
    return after


@dataclass
class Classifier:
    """Logistic weights by kind, length class and vote of each labeler."""

    bias: float
    kinds: list[float]
    sizes: list[float]
    labelers: list[list[float]]

    def accepts(self, span: Column) -> Column:
        def at(weights: list[float], i: Column) -> Column:
            return F.get(F.array(*map(F.lit, weights)), i)

        odds = F.lit(self.bias) + at(self.kinds, span["kind"]) + at(self.sizes, span["size"])
        for name, weights in zip(LABELERS, self.labelers, strict=True):
            odds = odds + at(weights, span["votes"][name] + 1)
        return odds >= math.log(ACCEPT / (1 - ACCEPT))


def train(counts: list[tuple[int, int, tuple[int, ...], bool, int]], steps: int = 400) -> Classifier:
    """Fits (kind, length class, votes, base, count) to the posteriors of ``reliabilities``."""
    model = Classifier(0.0, [0.0] * len(KINDS), [0.0] * 5, [[0.0] * 3 for _ in LABELERS])
    if not counts:
        model.bias = -1.0
        return model
    merged: dict[tuple, int] = {}
    for kind, _, vote, base, n in counts:
        merged[kind, vote, base] = merged.get((kind, vote, base), 0) + n
    keys = sorted(merged)
    known = dict(zip(keys, reliabilities([(*k, merged[k]) for k in keys]), strict=True))
    total = sum(c[-1] for c in counts)
    for _ in range(steps):
        rate = 2.0
        grads = Classifier(0.0, [0.0] * len(KINDS), [0.0] * 5, [[0.0] * 3 for _ in LABELERS])
        for kind, size, vote, base, n in counts:
            odds = model.bias + model.kinds[kind] + model.sizes[size]
            odds += sum(w[v + 1] for w, v in zip(model.labelers, vote, strict=True))
            gap = (known[kind, vote, base] - 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))) * n / total
            grads.bias += gap
            grads.kinds[kind] += gap
            grads.sizes[size] += gap
            for w, v in zip(grads.labelers, vote, strict=True):
                w[v + 1] += gap
        model.bias += rate * grads.bias
        pairs = [(model.kinds, grads.kinds), (model.sizes, grads.sizes)]
        for weights, grad in [*pairs, *zip(model.labelers, grads.labelers, strict=True)]:
            for i, g in enumerate(grad):
                weights[i] += rate * (g - 1e-4 * weights[i])
    return model


# --- on Spark -------------------------------------------------------------------------


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_proposed``: judged spans of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {"_base": judged(base(text), True), "_proposed": judged(proposed(text), False)}
    )


def learn(found: DataFrame) -> Classifier:
    """Counts combinations over all of ``found`` and fits on the counts."""
    spans = found.select(F.explode("_base").alias("s"), F.lit(True).alias("base")).unionByName(
        found.select(F.explode("_proposed").alias("s"), F.lit(False).alias("base"))
    )
    keys = ["base", F.col("s.kind"), F.col("s.size"), *[F.col(f"s.votes.{n}").alias(n) for n in LABELERS]]
    # Kinds, length classes and votes: a few hundred combinations at most occur.
    rows = spans.groupBy(*keys).count().collect()
    counts = [(r["kind"], r["size"], tuple(r[n] for n in LABELERS), r["base"], r["count"]) for r in rows]
    return train(sorted(counts))


def accepted(model: Classifier) -> Column:
    """All spans (start, kind, end) in order: the base ones and those added."""

    def clear(span: Column) -> Column:
        return ~F.exists(
            "_base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"])
        )

    def plain(s: Column) -> Column:
        return F.struct(s["start"], s["kind"], s["end"])

    added = F.filter("_proposed", lambda s: model.accepts(s) & clear(s))
    return F.array_sort(F.concat(F.transform("_base", plain), F.transform(added, plain)))


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` of every row: arrays of (start, kind, end) in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stage(candidates(rows).drop("text"), "pii-candidates")
    model = learn(found)
    plain = F.array_sort(
        F.transform("_base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    )
    return found.select("doc_id", plain.alias("base"), accepted(model).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets.

    Spans that overlap are one stretch, named by the first.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.concat(acc["parts"], F.array(F.concat(gap, F.get(names, s["kind"]))))
        parts = F.when(s["start"] >= acc["at"], fresh).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    return F.aggregate(
        spans,
        start,
        step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of its ``text`` masked; null texts stay null, other columns as they are."""
    model = learn(candidates(docs.select("text")))
    wrapped = docs.select(F.struct("*").alias("row"), "text")
    found = candidates(wrapped).withColumn("_spans", accepted(model))
    hit = F.when(F.size("_spans") > 0, mask(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    columns = [F.col("row").getField(c).alias(c) if c != "text" else hit.alias(c) for c in docs.columns]
    return found.select(*columns)
