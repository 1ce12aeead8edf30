"""One query per operator over its whole table, with the SQL that expresses it where SQL can."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm import audit, codes, decontam, embed_dedup, line_dedup, minhash, mixing, oracle, pieces, quality, secrets, substrings, topk, toxicity
from resona.llm.tables import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"),
    )


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.5)
    return found.select("doc_id", "held_out", "score", "predicted")


def vocabulary_path() -> str:
    """Where the public SentencePiece model lies; ``RESONA_PIECES`` names another."""
    return os.environ.get("RESONA_PIECES") or "/opt/tokenizers/piece_bpe_32k.model"


def op3_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's own ids of every text (the library's merges) and the max-plus path over the same pieces; round_trip: both decode to the text."""
    vocabulary = pieces.load(vocabulary_path())
    both = pieces.encode_both(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    digest = lambda ids: F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
    text = F.coalesce("text", F.lit(""))
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        digest("piece_ids").alias("ids_sha256"),
        F.size("path_ids").cast("long").alias("n_path_pieces"),
        digest("path_ids").alias("path_sha256"),
        F.col("path_chunks").alias("n_chunks"),
        ((F.col("decoded") == text) & (F.col("path_decoded") == text)).alias("round_trip"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.7)
    return found.select("doc_id", "held_out", "score", "predicted")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = codes.compress(table(spark, sf_dir, "embeddings"), rounds=6)
    return codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries():
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_line_quality": op2_line_quality,
        "op3_piece_encoding": op3_piece_encoding,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_exact_topk": op6_exact_topk,
        "op7_line_dedup": op7_line_dedup,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_source_mix": op10_source_mix,
        "op11_vector_codes": op11_vector_codes,
        "op12_filter_audit": op12_filter_audit,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql():
    return {
        "op4_substring_dedup": oracle.OP4,
        "op5_embedding_dedup": oracle.OP5,
        "op6_exact_topk": oracle.OP6,
        "op7_line_dedup": oracle.OP7,
        "op8_minhash_dedup": oracle.OP8,
        "op10_source_mix": oracle.OP10,
        "op11_vector_codes": oracle.OP11,
        "op12_filter_audit": oracle.OP12,
        "op13_decontamination": oracle.OP13,
    }
