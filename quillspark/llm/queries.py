"""Registered queries of the training-data operators, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import entropy_mix, gear_chunks, huffman, multi_index, pair_bpe, prefix_hash, resampling, rff_quality, spelling, warc, zstd_lang
from quillspark.llm.content_sort import exact_dedup
from quillspark.llm.simhash import near_dedup
from quillspark.llm.word_cache import word_encoder
from quillspark.session import table


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprints(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear_chunks.substring_dedup(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    dictionaries = zstd_lang.fit(docs, ~held_out)
    return zstd_lang.predict(docs, dictionaries, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rff_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    files = huffman.write(table(spark, sf_dir, "documents"), lambda: word_encoder(path), word_encoder(path).size, end=2)
    return huffman.read(files)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents"), "[A-Za-z\u00C0-\u00FF]", least=7, every=31))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_fingerprints": op1_prefix_fingerprints,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_entropy_mix": op4_entropy_mix,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_huffman_tokens": op6_huffman_tokens,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_pair_bpe": op8_pair_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_multi_index_ann": op12_multi_index_ann,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op10_warc": r"""
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
        ), f AS (
          SELECT page_id, n, sha256(h) AS d, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p
        )
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
        FROM f
    """,
}
