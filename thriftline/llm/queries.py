"""The registered queries of this subpackage: thin, each over a whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe,
    centroid_search,
    histogram_topk,
    importance_resampling,
    jaccard_join,
    license_dice,
    line_dedup,
    link_trust,
    lp_packing,
    rule_cascade,
    setsketch_dedup,
    text_density,
    warc_bundles,
)
from .oracle import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A vocabulary file, which lies at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_bundles.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = link_trust.link_trust(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_dice.license_scan(table(spark, sf_dir, "documents"), windows=True)
    return found.select("doc_id", "license", F.round("license_score", 6).alias("license_score"),
                        F.array_join("licenses", " ").alias("licenses"))


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_density.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rule_cascade.rule_cascade(docs, measures=rule_cascade.MEASURES)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op7_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return histogram_topk.histogram_topk(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lp_packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), outputs=("ids", "decoded"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_search.cluster(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_warc_bundles, op2_link_trust, op3_license_dice, op4_text_density, op5_jaccard_join, op6_rule_cascade,
    op7_histogram_topk, op8_lp_packing, op9_byte_bpe, op10_line_dedup,
    op11_centroid_clustering, op12_importance_resampling, op13_setsketch_dedup)}
