"""A corpus from raw documents to packed training sequences, in five stages.

Each stage is written as Parquet below the shared folder and read again, so a lost executor or a later failure
never repeats an earlier stage. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import exactdup, jaccard, mixing, packing, quality
from waymark.llm.queries import tokenizer_path
from waymark.llm.scratch import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside the limits of their language and source go. Each row is judged by its own text."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("_rest"), "lang", "source", "text")
    kept = quality.judge(rows, columns=("_rest",), keep_text=True).filter("kept")
    return kept.select(*(F.col("_text").alias("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the row with the smallest doc_id stays, once."""
    owners = exactdup.exact_dedup(docs, columns=("doc_id",)).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    named = docs.withColumn("_s", F.sha2(exactdup.fold(F.col("text")).cast("binary"), 256))
    kept = named.join(owners, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_s"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n-gram Jaccard join on five words at 0.8; of each group of linked documents one row stays, that with the smallest doc_id.

    Rows are told apart by a number of their own, so rows that repeat an id or have none are compared like all others; a row with an id stays before one without.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "numbered")
    found = jaccard.near_duplicates(numbered.select("row", "doc.text"), k=5, percent=80, id_col="row").select(F.col("doc_id").alias("_row"), "component_id")
    ids = numbered.select("row", "doc.doc_id").join(found, F.col("row") == F.col("_row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stays = ids.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("_row"))
    return numbered.join(stays, F.col("row") == F.col("_row"), "left_semi").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times."""
    return mixing.repeat_rows(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048 tokens; a repeated document is packed as often."""
    return packing.best_fit_packing(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Packing by a genetic algorithm is not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
