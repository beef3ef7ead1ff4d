"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillkit.llm import (byte_bpe, language_mix, license_scan, merkle, mixing, near_dup, quality_knn, rp_forest,
                         simhash, spelling, sql, suffix_dedup, token_counts, topk_search)
from tillkit.llm.common import read

COUNT_TOKENIZER = "byte_bpe_50k.json"
ENCODE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 5 highest inner products of every 50th vector."""
    return topk_search.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, score, via, license_path of every document as a file of a tree."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", license_scan.document_path().alias("path"), "text")
    return license_scan.scan(docs).select("doc_id", "license", "score", "via", "license_path")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, group_id (least doc_id of its near duplicates), group_size, kept."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > 1024)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(COUNT_TOKENIZER)).drop("text")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good) of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(language_mix.fold() != 0)
    scored = quality_knn.score(docs, quality_knn.learn(docs, labels))
    held = F.coalesce(language_mix.fold() == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of repeated 200-byte strings."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", suffix_dedup.sha256("kept").alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(ENCODE_RANKS))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_and_decode(docs, ranks)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 5 nearest found by cosine of every 50th vector."""
    return rp_forest.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op10_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs, shares of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_mix.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "langs", "shares")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Of every third document (by CRC) someone holds a text in lower case.
    """
    docs = read(spark, sf_dir, "documents").select(*merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    claimed = merkle.digest(*[text if f == "text" else F.col(f) for f in merkle.FIELDS])
    return merkle.audit(docs, claimed).withColumnRenamed("key", "doc_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of all texts."""
    return spelling.variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.simhash_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_topk_search, op2_license_scan, op3_order_minhash, op4_token_counts, op5_source_mix, op6_quality_knn,
        op7_suffix_dedup, op8_byte_bpe, op9_rp_forest, op10_language_mix, op11_merkle_manifest,
        op12_spelling_variants, op13_simhash_dedup)}

_TEMPLATES = ", ".join("('%s', '%s')" % t for t in license_scan.TEMPLATES)

#: Mixtures, hashes, EM, suffix order and BPE are outside SQL: tests hold those against brute force.
SQL: dict[str, str] = {
    "op11_merkle_manifest": sql.merkle(),
    "op12_spelling_variants": sql.spelling(),
    "op1_topk_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0),
        s AS (
          SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
                 list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
        r AS (
          SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
                 vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_license_scan": f"""
        WITH files AS (
          SELECT doc_id, text, CASE
            WHEN doc_id % 10000 = 0 THEN '/t' || (doc_id // 10000) || '/LICENSE'
            WHEN doc_id % 100 = 0 THEN '/t' || (doc_id // 10000) || '/d' || (doc_id // 100) || '/LICENSE'
            ELSE '/t' || (doc_id // 10000) || '/d' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path
          FROM documents),
        headers AS (
          SELECT doc_id, path, line FROM (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line FROM files)
          WHERE regexp_matches(line, '{license_scan.CUE}')),
        lines AS (SELECT line, count(*) AS files FROM headers GROUP BY line),
        known(license, line) AS (VALUES {_TEMPLATES}),
        terms AS (
          SELECT line, files, word, count(*) AS n FROM (
            SELECT line, files, unnest(regexp_extract_all(lower(line), '{license_scan.WORD}')) AS word FROM lines)
          GROUP BY line, files, word),
        idf AS (
          SELECT word, ln(((SELECT sum(files) FROM lines) + 1) / (sum(files) + 1)) + 1 AS idf
          FROM terms GROUP BY word),
        mine AS (SELECT line, word, (1 + ln(n)) * idf AS w FROM terms JOIN idf USING (word)),
        theirs AS (
          SELECT license, t.word, (1 + ln(n)) * coalesce(idf, ln(2) + 1) AS t FROM (
            SELECT license, word, count(*) AS n FROM (
              SELECT license, unnest(regexp_extract_all(lower(line), '{license_scan.WORD}')) AS word FROM known)
            GROUP BY license, word) t LEFT JOIN idf ON t.word = idf.word),
        scored AS (
          SELECT line, license, round(sum(w * t) / (any_value(wn) * any_value(tn)), 6) AS score
          FROM mine JOIN theirs USING (word)
          JOIN (SELECT line, sqrt(sum(w * w)) AS wn FROM mine GROUP BY line) USING (line)
          JOIN (SELECT license, sqrt(sum(t * t)) AS tn FROM theirs GROUP BY license) USING (license)
          GROUP BY line, license),
        own AS (
          SELECT doc_id, path, license, score FROM (
            SELECT doc_id, path, license, score,
                   row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r
            FROM headers JOIN scored USING (line) WHERE score >= {license_scan.LEAST}) WHERE r = 1),
        spoken AS (
          SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license, score, path AS license_path
          FROM own WHERE path LIKE '%/LICENSE'),
        near AS (
          SELECT f.doc_id, s.license, s.score, s.license_path,
                 row_number() OVER (PARTITION BY f.doc_id ORDER BY length(s.dir) DESC) AS r
          FROM files f JOIN spoken s ON starts_with(f.path, s.dir || '/'))
        SELECT f.doc_id, coalesce(o.license, n.license) AS license, coalesce(o.score, n.score) AS score,
               CASE WHEN o.license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'inherited' END AS via,
               CASE WHEN o.license IS NOT NULL THEN f.path ELSE n.license_path END AS license_path
        FROM files f LEFT JOIN own o ON f.doc_id = o.doc_id
        LEFT JOIN near n ON f.doc_id = n.doc_id AND n.r = 1""",
}
