"""Transcripts: provider JSON to text, segments and rendered lines, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "text string, language string, segments array<struct<text:string, start:string, end:string, speaker:string>>"


def normalized(payload: Column) -> Column:
    """struct(text, language, segments) of a JSON text; times that are no numbers are null, text falls back on the segments'."""
    own = F.from_json(payload, SCHEMA)
    time = lambda x: x.try_cast("double")
    segments = F.transform(own["segments"], lambda s: F.struct(F.trim(s["text"]).alias("text"), time(s["start"]).alias("start"), time(s["end"]).alias("end"), s["speaker"].alias("speaker")))
    text = F.coalesce(own["text"], F.concat_ws(" ", F.transform(segments, lambda s: s["text"])))
    return F.struct(text.alias("text"), own["language"].alias("language"), segments.alias("segments"))


def rendered(segments: Column) -> Column:
    """Lines ``[start-end] speaker: text``; a missing part is left out."""
    line = lambda s: F.concat_ws(" ", F.when(s["start"].isNotNull() & s["end"].isNotNull(), F.format_string("[%.1f-%.1f]", s["start"], s["end"])), F.concat(s["speaker"], F.lit(":")), s["text"])
    return F.concat_ws("\n", F.transform(segments, line))
