"""Registered queries of the text operators; SQL checks where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.llm import (
    html_text, line_dedup, merkle, metric_tree, mixture, ngram_quality, packing, personal_data, prefix_bpe, quality_rules,
    simhash, warc, whitening,
)
from tunewright.llm.common import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def keep(build: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return build
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hexed(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


@query("op4_line_dedup", """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.place, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS lost
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", hexed(F.col("kept_text")).alias("kept_sha256"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs, ["doc_id"]).select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs).select(
        "doc_id", simhash.hex_of(F.col("print")).alias("fingerprint"), "component_id")


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.personal_data(docs).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", hexed(F.col("base")).alias("base_sha256"),
        F.col("all").alias("spans"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op2_prefix_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), hexed(prefix_bpe.ids_text(F.col("ids"))).alias("ids_sha256"),
        hexed(F.col("decoded")).alias("decoded_sha256"))


@query("op3_warc", """
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM digests WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN coalesce(f.first, d.page_id) = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to, TRUE AS verified
FROM digests d LEFT JOIN firsts f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), spark).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


@query("op1_metric_tree_search", """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return metric_tree.top_k(vectors, F.col("vec_id") % 50 == 0)


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_kneser_ney_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return ngram_quality.quality_by_perplexity(docs, trusted)


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # A deviation past 64 bits (from some 10^8 rows on) is null here; the operator has it in 38 digits.
    return whitening.whitened_vectors(vectors).withColumn("deviation", F.col("deviation").try_cast("long"))


def merkle_check(levels: int = 6) -> str:
    """SQL for the manifest, with both trees unrolled to ``levels`` (enough for 16 ** levels documents of a source).

    A level is skipped for groups that are down to one node. crc32 is spelled out bit by bit.
    """
    def tree(name: str, group: str, last: int) -> str:
        """Runs and nodes of each level over ``<name>0 (group, idx, hash)``, and the single nodes left."""
        parts = []
        for n in range(last):
            parts.append(f"""{name}_runs{n} AS (
  SELECT {group}, idx // 16 AS parent, list(hash ORDER BY idx) AS hashes, any_value(size) AS size FROM (
    SELECT *, count(*) OVER (PARTITION BY {group}) AS size FROM {name}{n}) GROUP BY {group}, idx // 16
), {name}{n + 1} AS (
  SELECT {group}, parent AS idx, CASE WHEN size > 1 THEN sha256(array_to_string(hashes, '')) ELSE hashes[1] END AS hash
  FROM {name}_runs{n}
)""")
        return ", ".join(parts)

    def fold(name: str, group: str, source: str, out: str, idx: str, last: int) -> str:
        """Each document's siblings and recomputed hash, level by level."""
        parts, before = [], source
        for n in range(last):
            width = 16 ** n
            slot = f"({idx} // {width}) % 16"
            parts.append(f"""{out}{n} AS (
  SELECT d.* REPLACE (
    CASE WHEN r.size > 1 THEN sha256(array_to_string(r.hashes[1:{slot}], '') || d.node
      || array_to_string(r.hashes[{slot} + 2:], '')) ELSE d.node END AS node,
    CASE WHEN r.size > 1 THEN d.proof || array_to_string(r.hashes[1:{slot}], '')
      || array_to_string(r.hashes[{slot} + 2:], '') ELSE d.proof END AS proof)
  FROM {before} d JOIN {name}_runs{n} r ON r.{group} = d.{group} AND r.parent = {idx} // {16 * width}
)""")
            before = f"{out}{n}"
        return ", ".join(parts)

    def leaf(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH sums AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN NULL ELSE xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
      ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END)) END AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS src, {leaf("text")} AS leaf,
    CASE WHEN crc % 5 = 0 AND text IS NOT NULL THEN {leaf(lowered)} ELSE {leaf("text")} END AS node FROM sums
), docs AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, '' AS proof, 0 AS one FROM leaves
), d0 AS (SELECT src, idx, leaf AS hash FROM docs), {tree("d", "src", levels)},
subroots AS (
  SELECT src, hash AS subroot, 0 AS one, row_number() OVER (ORDER BY src) - 1 AS place FROM d{levels}
), s0 AS (SELECT one, place AS idx, subroot AS hash FROM subroots), {tree("s", "one", levels)},
{fold("d", "src", "docs", "u", "d.idx", levels)},
joined AS (SELECT u.*, subroot, place FROM u{levels - 1} u JOIN subroots USING (src)),
{fold("s", "one", "joined", "v", "d.place", levels)}
SELECT doc_id, leaf, subroot, s{levels}.hash AS root, sha256(proof) AS proof_sha256, node AS folded_root,
  node = s{levels}.hash AS verified
FROM v{levels - 1}, s{levels}"""


@query("op12_merkle_manifest", merkle_check())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.tampered_manifest(docs)


@query("op13_mixture_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.mixed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))
