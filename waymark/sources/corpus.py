"""Readers: texts with their lines, recordings with their line times, JSON lines, captions. All give DataFrames with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import captions

TEXT = "dua_id string, dua_name_en string, dua_name_ar string, source string, segments array<struct<segment_id: int, arabic: string, translation_en: string, transliteration: string>>"
EXTRA = "dua_id string, segments array<struct<segment_id: int, translation_en: string, transliteration: string>>"
RECORDING = "audio_id string, dua_id string, reciter string, duration_ms long, slide_start_ms map<string, long>, auto boolean, condition string, venue string, needs_review boolean, reviewed string, teacher string"


def lines(spark: SparkSession, path: str, extra: DataFrame | None = None, popularity: DataFrame | None = None) -> DataFrame:
    """One row per line of each JSON text below `path`: (text_id, name, line_id, text, translation, transliteration, recordings).

    `extra` (EXTRA's columns: a side file per text) fills translations and transliterations that are missing or empty. `popularity` (dua_id, recordings): 0 where a text has none.
    """
    texts = spark.read.schema(TEXT).option("multiLine", True).json(path)
    rows = texts.select("dua_id", F.coalesce("dua_name_en", F.lit("")).alias("name"), F.inline("segments"))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    if extra is not None:
        more = extra.select(F.col("dua_id").alias("_d"), F.inline("segments")).select("_d", F.col("segment_id").alias("_s"), F.col("translation_en").alias("_tr"), F.col("transliteration").alias("_tl"))
        rows = rows.join(more, (F.col("dua_id") == F.col("_d")) & (F.col("segment_id") == F.col("_s")), "left")
    else:
        rows = rows.withColumn("_tr", F.lit(None).cast("string")).withColumn("_tl", F.lit(None).cast("string"))
    rows = rows.select("dua_id", "name", F.col("segment_id").alias("line_id"), F.col("arabic").alias("text"), F.coalesce(filled(F.col("translation_en")), "_tr").alias("translation"), F.coalesce(filled(F.col("transliteration")), "_tl").alias("transliteration"))
    if popularity is None:
        return rows.withColumn("recordings", F.lit(0).cast("long")).withColumnRenamed("dua_id", "text_id")
    known = popularity.select(F.col("dua_id").alias("_d"), F.col("recordings").cast("long").alias("_n"))
    return rows.join(known, F.col("dua_id") == F.col("_d"), "left").select(F.col("dua_id").alias("text_id"), "name", "line_id", "text", "translation", "transliteration", F.coalesce("_n", F.lit(0).cast("long")).alias("recordings"))


def recordings(spark: SparkSession, path: str, n_lines: DataFrame, audio: DataFrame | None = None) -> DataFrame:
    """Recordings with (starts, end_s): `n_lines` has (dua_id, n_lines). With `audio` (audio_id) those without a sound file are left out.

    A file x.repaired.json takes the place of x.json.
    """
    raw = spark.read.schema(RECORDING).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_name"))
    raw = raw.withColumn("_rank", F.col("_file").endswith(".repaired.json").cast("int"))
    best = raw.groupBy("audio_id").agg(F.max_by(F.struct(*raw.columns), "_rank").alias("r")).select("r.*").drop("_file", "_rank")
    if audio is not None:
        best = best.join(audio.select("audio_id").distinct(), "audio_id", "left_semi")
    known = best.join(n_lines.select("dua_id", F.col("n_lines").cast("int").alias("_n")), "dua_id")
    return known.withColumn("starts", captions.line_starts(F.col("slide_start_ms"), F.col("_n"))).withColumn("end_s", captions.labels_end(F.col("slide_start_ms"), F.col("_n"), F.col("duration_ms"))).drop("_n")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse, such as a last one cut off by a crash, are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def windows(spark: SparkSession, path: str, hallucinated, vad: bool = False) -> DataFrame:
    """Cached transcript windows (rec, t, text): text that the current filters reject, or that has no speech where speech is asked for, is empty."""
    rows = json_lines(spark, path, "t double, text string, speech boolean").withColumn("rec", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_w[0-9]+_h[0-9]+)?\.jsonl$", 1))
    silent = hallucinated(F.col("text")) | (F.lit(vad) & ~F.coalesce("speech", F.lit(True)))
    return rows.select("rec", "t", F.when(silent, "").otherwise(F.col("text")).alias("text"))


def caption_files(spark: SparkSession, path: str) -> DataFrame:
    """Cues of .srt files (start_s, end_s, line_id) and .vtt files (start_s, end_s, text) below `path`, with the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    srt = files.filter(F.col("file").endswith(".srt")).select("file", F.inline(captions.srt_cues(F.col("value")))).withColumn("text", F.lit(None).cast("string"))
    vtt = files.filter(F.col("file").endswith(".vtt")).select("file", F.inline(captions.vtt_cues(F.col("value")))).withColumn("line_id", F.lit(None).cast("int"))
    return srt.unionByName(vtt)
