"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogforge.llm import (
    alignment,
    bpe,
    decontaminate,
    langid,
    manifest,
    merkle,
    pii,
    quality,
    sharding,
    simhash,
    suffix,
    token_files,
    warc,
)
from catalogforge.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


@query
def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"))
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return bpe.decode(ids).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), out)
    return token_files.checksums(token_files.read(spark, out))


@query
def op4_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base32 writes five bits a letter: five hexadecimal digits are four letters.
ORACLES["op4_seekable_warc"] = """WITH payloads AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hexed FROM pages
    ), coded AS (
        SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS top,
            array_to_string(list_transform(range(0, 32), lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST('0x' || substr(hexed, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT)
                    >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '')
                AS payload_digest
        FROM payloads
    )
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
        CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> top THEN top END AS refers_to
    FROM coded"""


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = merkle.with_next(table(spark, sf_dir, "documents"))
    printed = pairs.withColumn("edited_fp", merkle.fingerprint("edited"))
    return printed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        merkle.likeness("fp", "edited_fp").alias("near_edited"),
        merkle.likeness("fp", "next_fp").alias("near_next"),
    )


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items)


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{pii.KINDS[k]}") for k in pii.BASE],
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summary(table(spark, sf_dir, "documents"))


@query
def op12_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.Manifest(table(spark, sf_dir, "documents")).checks()


def _manifest_sql(levels: int = 6) -> str:
    """The tree of each source and the one above, level by level; enough for 16 ** ``levels`` leaves."""
    parts = [
        """WITH bits AS (
        SELECT list_transform(range(0, 256), lambda n: list_reduce(
            [n, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
    ), heads AS (
        SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
            || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
            xor(4294967295, list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), list_transform(
                    range(1, strlen(CAST(doc_id AS VARCHAR)) + 1),
                    lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT))),
                lambda c, b: xor(c // 256, crc[CAST(xor(c, b) % 256 AS BIGINT) + 1]))) AS sum
        FROM documents, bits
    ), leaves AS (
        SELECT doc_id, coalesce('+' || source, '') AS tree,
            sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            CASE WHEN coalesce(sum % 5 = 0, false)
                THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS changed
        FROM heads
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM leaves
    ), s0 AS (SELECT tree, spot, leaf AS d FROM placed)"""
    ]

    def tree(name: str) -> str:
        """Levels above ``name0`` (``tree, spot, d``); a tree of one node stays as it is."""
        out = ""
        for i in range(levels):
            out += f""", {name}{i + 1} AS (
        SELECT tree, spot // 16 AS spot,
            CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY spot)) ELSE any_value(d) END AS d
        FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{i}) GROUP BY tree, spot // 16)"""
        return out

    def fold(name: str, source: str, base: str) -> str:
        """Takes each row of ``source`` (``tree, spot, others, folded``) up the levels of ``name``."""
        out, before = "", source
        for i in range(levels):
            out += f""", {name}runs{i} AS (
        SELECT tree, spot // 16 AS up, list(d ORDER BY spot) AS ds, any_value(n) AS n
        FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {base}{i}) GROUP BY tree, spot // 16
    ), {name}{i + 1} AS (
        SELECT f.* EXCLUDE (spot, others, folded), f.spot // 16 AS spot,
            CASE WHEN n > 1 THEN others || array_to_string(ds[1:k], '') || array_to_string(ds[k + 2:], '')
                ELSE others END AS others,
            CASE WHEN n > 1 THEN sha256(array_to_string(ds[1:k], '') || folded || array_to_string(ds[k + 2:], ''))
                ELSE folded END AS folded
        FROM (SELECT *, CAST(spot % 16 AS BIGINT) AS k FROM {before}) f
        JOIN {name}runs{i} r ON f.tree = r.tree AND f.spot // 16 = r.up)"""
            out = out.replace("f.* EXCLUDE (spot, others, folded)", "f.* EXCLUDE (spot, others, folded, k)")
            before = f"{name}{i + 1}"
        return out

    parts.append(tree("s"))
    parts.append(
        f""", ordered AS (
        SELECT tree AS source_tree, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM s{levels}
    ), t0 AS (SELECT 0 AS tree, place AS spot, subroot AS d FROM ordered)"""
    )
    parts.append(tree("t"))
    parts.append(
        """, begun AS (
        SELECT tree, spot, doc_id, leaf, '' AS others, coalesce(changed, leaf) AS folded FROM placed)"""
    )
    parts.append(fold("up", "begun", "s"))
    parts.append(
        f""", sources AS (
        SELECT 0 AS tree, o.place AS spot, u.doc_id, u.leaf, o.subroot, u.others, u.folded
        FROM up{levels} u JOIN ordered o ON u.tree = o.source_tree)"""
    )
    parts.append(fold("top", "sources", "t"))
    parts.append(
        f"""
    SELECT doc_id, leaf, subroot, d AS root, sha256(others) AS proof_sha256, folded AS folded_root, folded = d AS verified
    FROM top{levels}, t{levels}"""
    )
    return "".join(parts)


ORACLES["op13_merkle_manifest"] = _manifest_sql()
