"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A paragraph is a line. Its leaves are runs of up to eight words that also end with a
sentence, so a change inside a paragraph touches few of them. Sections are runs of
paragraphs that end where a paragraph's own digest says so, so text put in or taken out
elsewhere does not shift them. The root covers the sections, a section its paragraphs, a
paragraph its exact text. A fingerprint writes the tree out as text::

    root : paragraph digests, each closing with "," or, at the end of a section, "|" : leaf digests

Equal roots mean equal texts; ``differing`` walks two unequal trees down to the
paragraphs that differ; ``likeness`` is the Dice share of their distinct leaves.

Everything is SQL functions. Texts move in one shuffle; what the pairing with the next
document needs besides is its prefix and its fingerprint.

Defined cases: null texts count as empty, and an empty text is one empty paragraph with no
leaf; two texts without leaves are alike (1) if their roots are equal, else 0; a null
``doc_id`` comes after all others; rows equal in ``doc_id`` and text are one document and
each get its result; documents that share a ``doc_id`` follow one another by digest; a
single document is its own next; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogforge.llm.common import texts
from catalogforge.operators.ordering import global_positions
from catalogforge.session import stage

# Leaves: words of at most so many characters, at most eight of them, and the blanks
# around; a sentence ends a leaf. Together they cover a paragraph exactly.
SENTENCE = r"(?<=[.!?]\s)"
LEAF = r"\s*+(?:\S{1,64}+\s*+){1,8}+|\s++"
PARAGRAPH_HEX, LEAF_HEX = 16, 8
# A paragraph ends a section if its digest ends so: one in four.
SECTION_END = ("0", "4", "8", "c")


def _as_column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def paragraphs(text: Column | str) -> Column:
    """The lines of a text, empty ones too."""
    return F.split(_as_column(text), "\n", -1)


def leaves(text: Column | str) -> Column:
    """The distinct leaf digests of a text, in order."""
    pieces = F.flatten(
        F.transform(
            F.split(_as_column(text), rf"\n|{SENTENCE}"),
            lambda s: F.regexp_extract_all(s, F.lit(LEAF), F.lit(0)),
        )
    )
    digests = F.transform(pieces, lambda p: F.substring(F.md5(F.trim(p)), 1, LEAF_HEX))
    return F.array_distinct(digests)


def fingerprint(text: Column | str) -> Column:
    """The tree of a text, written out as described above."""

    def closed(paragraph: Column) -> Column:
        digest = F.substring(F.md5(paragraph), 1, PARAGRAPH_HEX)
        return F.concat(digest, F.when(F.right(digest, F.lit(1)).isin(*SECTION_END), "|").otherwise(","))

    tree = F.array_join(F.transform(paragraphs(text), closed), "")
    return F.concat_ws(":", root(tree), tree, F.array_join(leaves(text), ","))


def root(tree: Column) -> Column:
    """The root digest over the sections of the paragraph digests."""
    sections = F.transform(F.split(tree, r"\|", -1), lambda s: F.substring(F.md5(s), 1, PARAGRAPH_HEX))
    return F.md5(F.array_join(sections, ","))


def _part(fp: Column | str, n: int) -> Column:
    return F.split_part(_as_column(fp), F.lit(":"), F.lit(n))


def _leaf_list(fp: Column | str) -> Column:
    part = _part(fp, 3)
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ","))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Dice share of the distinct leaves of two fingerprints, 1 for equal roots."""
    x, y = _leaf_list(a), _leaf_list(b)
    total = F.size(x) + F.size(y)
    shared = F.size(F.array_intersect(x, y))
    dice = F.when(total == 0, F.lit(0.0)).otherwise(2.0 * shared / total)
    return F.when(_part(a, 1) == _part(b, 1), F.lit(1.0)).otherwise(dice)


def differing(a: Column | str, b: Column | str) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` in sections that ``b`` lacks and not in ``b``."""
    here = F.split(_part(a, 2), r"(?<=\|)")
    there = F.split(_part(b, 2), r"(?<=\|)")
    same = F.array_intersect(here, there)
    # Sections met in both drop out whole; only the others open up.
    spread = F.flatten(
        F.transform(
            here,
            lambda s: F.transform(
                F.split(F.regexp_replace(s, r"[,|]$", ""), ","),
                lambda p: F.when(F.array_contains(same, s), F.lit(None)).otherwise(p),
            ),
        )
    )
    known = F.split(_part(b, 2), r"[,|]")
    numbered = F.transform(spread, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    changed = F.filter(numbered, lambda x: x["p"].isNotNull() & (x["p"] != "") & ~F.array_contains(known, x["p"]))
    return F.transform(changed, lambda x: x["i"])


def edited(text: Column, next_text: Column) -> Column:
    """The last half of a text replaced by as much (or all) of the start of the next."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(next_text, half))


def with_next(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint, its edited text and the next one's fingerprint.

    ``doc_id, text, n_chars, fp, edited, next_fp``; the next document is the one with
    the next smaller ``doc_id``, and the largest after the last.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text"))
    rows = texts(docs).select(key.alias("key"), "doc_id", "text")
    facts = stage(
        rows.groupBy("key").agg(
            F.first("doc_id").alias("doc_id"),
            F.first(F.char_length("text")).alias("n"),
            F.count("*").alias("copies"),
        ),
        "merkle-keys",
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    at = global_positions(facts, order)
    at = stage(at.select("key", "doc_id", "n", F.col("position").cast("long").alias("p")), "merkle-order")
    count, copies = facts.agg(F.count("*"), F.max("copies")).first()
    # For each document the one after it, and how much of its start the document needs.
    turn = F.lit(max(count, 1))
    before = at.select(
        F.col("key").alias("for_key"),
        "doc_id",
        F.floor(F.col("n") / 2).cast("int").alias("wanted"),
        F.pmod(F.col("p") + 1, turn).alias("p"),
    )
    asked = at.select("key", F.pmod("p", turn).alias("p")).join(before, "p").drop("p")
    # The same columns feed both joins, so one shuffle of the texts serves both. Each side
    # prints its own fingerprints after it, which is cheaper than to move them.
    plain = rows.select("key", "text")
    sent = plain.join(asked.hint("shuffle_hash"), "key").select(
        F.col("for_key").alias("key"),
        "doc_id",
        F.left("text", F.col("wanted")).alias("start"),
        fingerprint("text").alias("next_fp"),
    )
    if (copies or 1) > 1:
        # A document that repeats has sent as many equal rows.
        sent = sent.dropDuplicates(["key"])
    return plain.join(sent, "key").select(
        "doc_id",
        "text",
        F.char_length("text").cast("long").alias("n_chars"),
        fingerprint("text").alias("fp"),
        edited(F.col("text"), F.col("start")).alias("edited"),
        "next_fp",
    )
