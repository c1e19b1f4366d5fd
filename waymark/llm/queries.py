"""The registered queries of this subpackage: thin selections over the operators, on whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from waymark.llm import bytespans, exactdup, jaccard, lmscore, mixing, oracles, packing, quality, substrings, urlrules, warc


def tokenizer_path() -> str:
    """The tokenizer file: WAYMARK_TOKENIZER, else that of the installed public tokenizers."""
    if path := os.environ.get("WAYMARK_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark, sf_dir):
    scored = lmscore.stupid_backoff(_table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", "n_backoffs", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op2_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exactdup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest", columns=("doc_id",))


def op4_url_filters(spark, sf_dir):
    return urlrules.judge(_table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_warc(spark, sf_dir):
    return warc.read(spark, warc.write(_table(spark, sf_dir, "pages")))


def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark, sf_dir):
    return bytespans.repeated_bytes(_table(spark, sf_dir, "documents")).drop("spans")


def op9_substring_dedup(spark, sf_dir):
    return substrings.repeated_passages(_table(spark, sf_dir, "documents")).drop("spans")


def op10_quality_rules(spark, sf_dir):
    return quality.judge(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_mixing, op3_exact_dedup, op4_url_filters, op5_best_fit_packing, op6_warc, op7_ngram_jaccard_join, op8_suffix_array_dedup, op9_substring_dedup, op10_quality_rules)}

ORACLES = oracles.ORACLES
