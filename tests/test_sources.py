"""Readers on small files: side files, empty fields, repaired recordings, cut-off JSON lines, captions."""

import json

from pyspark.sql import functions as F

from waymark.sources import corpus


def _write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=1), encoding="utf-8")


def test_lines_with_side_file_and_popularity(spark, tmp_path):
    _write(tmp_path / "texts/a.json", {"dua_id": "a", "dua_name_en": "A", "segments": [{"segment_id": 1, "arabic": "اب", "translation_en": ""}, {"segment_id": 2, "arabic": "ج", "translation_en": "own"}]})
    _write(tmp_path / "texts/b.json", {"dua_id": "b", "segments": [{"segment_id": 1, "arabic": "د"}]})
    extra = spark.createDataFrame([("a", [(1, "side", "ab"), (2, "side", None)])], corpus.EXTRA)
    known = spark.createDataFrame([("a", 7)], "dua_id string, recordings int")
    got = {(r.text_id, r.line_id): (r.name, r.text, r.translation, r.transliteration, r.recordings) for r in corpus.lines(spark, f"{tmp_path}/texts/*.json", extra, known).collect()}
    assert got == {("a", 1): ("A", "اب", "side", "ab", 7), ("a", 2): ("A", "ج", "own", None, 7), ("b", 1): ("", "د", None, None, 0)}
    assert corpus.lines(spark, f"{tmp_path}/texts/*.json").filter("recordings = 0 and transliteration is null").count() == 3


def test_recordings_take_repairs_and_need_sound(spark, tmp_path):
    meta = {"audio_id": "x", "dua_id": "a", "duration_ms": 9000, "slide_start_ms": {"1": 100, "2": 4000, "3": 8000}}
    _write(tmp_path / "rec/x.json", meta)
    _write(tmp_path / "rec/x.repaired.json", meta | {"slide_start_ms": {"1": 200, "2": 4000}})
    _write(tmp_path / "rec/y.json", meta | {"audio_id": "y"})
    _write(tmp_path / "rec/z.json", meta | {"audio_id": "z"})
    n = spark.createDataFrame([("a", 2)], "dua_id string, n_lines int")
    audio = spark.createDataFrame([("x",), ("y",)], "audio_id string")
    got = {r.audio_id: ([(s.start_s, s.line_id) for s in r.starts], r.end_s) for r in corpus.recordings(spark, f"{tmp_path}/rec/*.json", n, audio).collect()}
    assert got == {"x": ([(0.2, 1), (4.0, 2)], 9.0), "y": ([(0.1, 1), (4.0, 2)], 8.0)}


def test_windows_skip_broken_lines_and_silence(spark, tmp_path):
    _write(tmp_path / "w/rec1_w6_h1.jsonl", '{"t": 1, "text": "a b"}\n{"t": 2, "text": "junk", "speech": true}\n{"t": 3, "text": "c", "speech": false}\n{"t": 4, "te')
    read = lambda vad: [tuple(r) for r in corpus.windows(spark, f"{tmp_path}/w/*.jsonl", lambda x: x == F.lit("junk"), vad).orderBy("t").collect()]
    assert read(False) == [("rec1", 1.0, "a b"), ("rec1", 2.0, ""), ("rec1", 3.0, "c")]
    assert read(True)[2] == ("rec1", 3.0, "")


def test_caption_files(spark, tmp_path):
    _write(tmp_path / "c/a.srt", "1\n00:00:01,000 --> 00:00:02,000\n7. x\n")
    _write(tmp_path / "c/b.vtt", "WEBVTT\n\n00:01.000 --> 00:02.500\nhello\n")
    got = sorted((r.file, r.start_s, r.end_s, r.line_id, r.text) for r in corpus.caption_files(spark, f"{tmp_path}/c").collect())
    assert got == [("a.srt", 1.0, 2.0, 7, None), ("b.vtt", 1.0, 2.5, None, "hello")]
