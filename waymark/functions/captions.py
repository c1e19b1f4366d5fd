"""Timed captions as Column expressions: SRT and VTT texts to cues, line times to SRT, and the codec of line-time maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SRT = r"([0-9]+):([0-9]{2}):([0-9]{2})[,.]([0-9]{1,3})\s*-->\s*([0-9]+):([0-9]{2}):([0-9]{2})[,.]([0-9]{1,3})"
_VTT = r"(?:([0-9]+):)?([0-9]+):([0-9.]+) --> (?:([0-9]+):)?([0-9]+):([0-9.]+)"


def _number(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found == "", F.lit(0.0)).otherwise(found.cast("double"))


def _clock(text: Column, first: int) -> Column:
    """Seconds of an SRT time whose hours are group `first`; a fraction of one or two digits is tenths or hundredths."""
    h, m, s = (_number(text, _SRT, first + i) for i in range(3))
    return F.round(h * 3600 + m * 60 + s + F.rpad(F.regexp_extract(text, _SRT, first + 3), 3, "0").cast("double") / 1000, 3)


def srt_cues(srt: Column) -> Column:
    """array<struct<start_s, end_s, line_id>> by time; the line id is the number before the first dot of a cue's text, cues without one are left out."""
    blocks = F.split(F.trim(F.replace(srt, F.lit("\r\n"), F.lit("\n"))), r"\n\s*\n")

    def cue(block: Column) -> Column:
        body = F.regexp_extract(block, r"(?s)-->[^\n]*\n(.*)$", 1)
        line = F.regexp_extract(body, r"^\s*([0-9]+)\s*\.", 1)
        return F.struct(_clock(block, 1).alias("start_s"), _clock(block, 5).alias("end_s"), F.when(line != "", line.cast("int")).alias("line_id"))

    return F.array_sort(F.filter(F.transform(F.filter(blocks, lambda b: b.rlike(_SRT)), cue), lambda c: c.line_id.isNotNull()))


def srt_time(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    part = lambda size, n: (ms / size).cast("long") % n
    return F.format_string("%02d:%02d:%02d,%03d", (ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms % 1000)


def to_srt(starts: Column, end_s: Column) -> Column:
    """array<struct<start_s, line_id, text>>, ascending -> SRT; each cue runs to the next start, the last to end_s."""

    def cue(c: Column, i: Column) -> Column:
        until = F.coalesce(F.get(starts, i + 1)["start_s"], end_s)
        return F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(c.start_s), F.lit(" --> "), srt_time(until), F.lit("\n"), c.line_id.cast("string"), F.lit(". "), F.coalesce(c.text, F.lit("")), F.lit("\n"))

    return F.array_join(F.transform(starts, cue), "\n")


def vtt_cues(vtt: Column) -> Column:
    """array<struct<start_s, end_s, text>>: times with or without hours, tags stripped, empty cues left out."""
    blocks = F.split(F.replace(vtt, F.lit("\r"), F.lit("")), "\n\n")

    def cue(block: Column) -> Column:
        def at(first: int) -> Column:
            return F.round(_number(block, _VTT, first) * 3600 + _number(block, _VTT, first + 1) * 60 + _number(block, _VTT, first + 2), 3)

        text = F.trim(F.replace(F.regexp_replace(F.regexp_extract(block, r"(?s)-->[^\n]*\n(.+)$", 1), "<[^>]+>", ""), F.lit("\n"), F.lit(" ")))
        return F.struct(at(1).alias("start_s"), at(4).alias("end_s"), text.alias("text"))

    return F.filter(F.transform(F.filter(blocks, lambda b: b.rlike(_VTT)), cue), lambda c: c.text != "")


def line_starts(slide_ms: Column, n_lines: Column) -> Column:
    """map<line as text, ms> -> array<struct<start_s, line_id>> by time; keys past the last line are no lines."""
    entries = F.transform(F.map_entries(slide_ms), lambda e: F.struct((e.value / 1000).alias("start_s"), e.key.cast("int").alias("line_id")))
    return F.array_sort(F.filter(entries, lambda e: e.line_id <= n_lines))


def labels_end(slide_ms: Column, n_lines: Column, duration_ms: Column) -> Column:
    """Seconds at which the labels end: the first key past the last line, else the recording's length."""
    after = F.array_min(F.transform(F.filter(F.map_entries(slide_ms), lambda e: e.key.cast("int") > n_lines), lambda e: e.value))
    return F.coalesce(after, duration_ms) / 1000


def slide_map(starts: Column, end_s: Column, n_lines: Column, duration_ms: Column) -> Column:
    """The map back; an end mark (last line + 1) only if the labels stop over a millisecond early."""
    entry = lambda k, v: F.struct(k.cast("string").alias("key"), F.round(v * 1000).cast("long").alias("value"))
    entries = F.transform(starts, lambda s: entry(s.line_id, s.start_s))
    mark = F.when(end_s * 1000 < duration_ms - 1, F.array(entry(n_lines + 1, end_s))).otherwise(F.slice(entries, 1, 0))
    return F.map_from_entries(F.concat(entries, mark))
