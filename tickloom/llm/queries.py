"""The queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import chat_format, fingerprints, hard_negatives, html_consensus, license_scan, line_dedup, media_avi, ngram_join, packing, periodic_runs, quality, secret_scan, sentencepiece_dropout
from tickloom.llm.common import ids_and_text, table

DROPOUT_RATE, DROPOUT_SEED = 0.1, 20_260
QUALITY_SEED = 7


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the sampled segmentation of each document, and of what it decodes to."""
    path = packing.tokenizer_path("piece_bpe_32k.model")
    encoded = sentencepiece_dropout.encode(table(spark, sf_dir, "documents"), path, DROPOUT_RATE, DROPOUT_SEED)
    decoded = sentencepiece_dropout.decode(encoded, path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.length("decoded").cast("long").alias("n_chars_decoded"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "literal")
    return secret_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(secret_scan.count_of(spans, k).alias(f"n_{k}") for k in secret_scan.KINDS),
        F.sha2(secret_scan.digest(base), 256).alias("base_sha256"),
        secret_scan.digest(spans).alias("spans"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op4_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract(table(spark, sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.describe(media_avi.to_avi(table(spark, sf_dir, "documents")))


def op6_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed clips of the stored media of each document."""
    return media_avi.clips(media_avi.to_avi(table(spark, sf_dir, "documents")))


def op7_bottom_k_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.tokenizer_path("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents; the others are rejected."""
    docs = ids_and_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    kept, _ = quality.sample(docs, table(spark, sf_dir, "labels"), QUALITY_SEED)
    return kept.drop("key_bits")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the runs of each document, some of which repeat a stretch of their words, and of the text without them."""
    docs = ids_and_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = periodic_runs.find_runs(periodic_runs.planted(docs)).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row mines negatives; the labels of every seventh row are moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.rows_of(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_dropout": op1_sentencepiece_dropout,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_format": op3_chat_format,
    "op4_html_consensus": op4_html_consensus,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_media_avi": op6_media_avi,
    "op6_media_clips": op6_media_clips,
    "op7_bottom_k_fingerprint": op7_bottom_k_fingerprint,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_resampling": op10_quality_resampling,
    "op11_license_scan": op11_license_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat_format.ORACLE,
    "op11_license_scan": license_scan.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
