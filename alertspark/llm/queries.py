"""The registered queries: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE_RULES, scan_versions, span_list

    base = [r.kind for r in BASE_RULES]
    f = scan_versions(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return f.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in base],
        F.sha2(span_list(F.filter("findings", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        span_list(F.col("findings")).alias("spans"))


def op2_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown_lm import class_scores

    return class_scores(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_strings

    return repeated_strings(table(spark, sf_dir, "documents"))


def op4_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_templates import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import occurrences

    return occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_maxplus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sp_scan import decode, encode

    rows = decode(encode(table(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())
    return rows.select("doc_id", "chunk", "n_chunks", F.size("pieces").cast("long").alias("n_pieces"), "pieces",
                       F.sha2("text", 256).alias("decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_cache import token_counts

    n = token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return n.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .risk_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_shards import N_SHARDS, shard_rows

    rows = shard_rows(table(spark, sf_dir, "documents"), N_SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op10_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .partenum import similar_sets

    return similar_sets(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_cover_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_ledger": op1_secret_ledger,
    "op2_brown_classes": op2_brown_classes,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_site_templates": op4_site_templates,
    "op5_benchmark_leaks": op5_benchmark_leaks,
    "op6_maxplus_scan": op6_maxplus_scan,
    "op7_token_counts": op7_token_counts,
    "op8_risk_rules": op8_risk_rules,
    "op9_kd_shards": op9_kd_shards,
    "op10_partenum_join": op10_partenum_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_cover_negatives": op12_cover_negatives,
    "op13_language_mixture": op13_language_mixture,
}
