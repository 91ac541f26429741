"""The registered queries of this folder: name -> (function of (spark, sf_dir), SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from respondex.llm import byte_bpe, fingerprints, fuzzy_lines, lexical_search, licenses, mixing, ngram_join, sentencepiece_spans, substrings, toxicity, vector_links, warc, whitening

Run = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package is part of the installation, not of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(_read(spark, sf_dir, "documents"), n=3, percent=90)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    encoded = sentencepiece_spans.encode_documents(_read(spark, sf_dir, "documents"), model_path or tokenizer_path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op5_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.link_vectors(_read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_page AND first_page IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to FROM d"""


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"edited_sha256": F.sha2(F.col("edited_text").cast("binary"), 256)}
    return fingerprints.fingerprint_documents(_read(spark, sf_dir, "documents"), derived=digest).drop("edited_text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.drop_fuzzy_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_filled", "n_removed", "removed", "text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeated_spans(_read(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    encoded = byte_bpe.encode_corpus(_read(spark, sf_dir, "documents"), ranks_path or tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten_vectors(_read(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, tuple[Run, str | None]] = {
    "op1_ngram_join": (op1_ngram_join, None),
    "op2_mix_sources": (op2_mix_sources, mixing.mixing_sql()),
    "op3_sentencepiece": (op3_sentencepiece, None),
    "op4_license_scan": (op4_license_scan, licenses.licenses_sql()),
    "op5_vector_links": (op5_vector_links, None),
    "op6_warc": (op6_warc, OP6_SQL),
    "op7_line_dedup": (op7_line_dedup, None),
    "op8_substring_dedup": (op8_substring_dedup, substrings.substrings_sql()),
    "op9_toxicity": (op9_toxicity, None),
    "op10_fingerprints": (op10_fingerprints, None),
    "op11_byte_bpe": (op11_byte_bpe, None),
    "op12_whitening": (op12_whitening, None),
    "op13_lexical_search": (op13_lexical_search, lexical_search.search_sql()),
}
