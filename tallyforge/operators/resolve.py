"""Spans of long texts read through blocks, so that a span touches its blocks only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def blocks(texts: DataFrame, key: str, text: str, size: int = BLOCK) -> DataFrame:
    """(key, block, part, n_chars): the text of each key in parts of ``size`` code points. Write it once and resolve many batches."""
    n = F.char_length(text)
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"int((char_length({text}) - 1) div {size})")))
    cut = texts.where(F.col(text).isNotNull()).select(key, text, n.alias("n_chars"), F.explode(numbers).alias("block"))
    return cut.select(key, "block", F.substring(F.col(text), F.col("block") * size + 1, F.lit(size)).alias("part"), "n_chars")


def resolved(index: DataFrame, spans: DataFrame, key: str, span: str, size: int = BLOCK) -> DataFrame:
    """(span, value, status) for spans (span, key, start, until, checksum): code points from 0, until exclusive.

    status: resolved, unknown (no such key), out_of_range (also empty or reversed spans) or changed (the SHA-256 isn't ``checksum``; null
    isn't checked). Only resolved spans have a value. The spans are counted out to the blocks that they touch before they meet
    them; the first block of a key tells its length.
    """
    sizes = index.where("block = 0").select(key, "n_chars")
    known = spans.join(sizes, key, "left")
    inside = (F.col("start") >= 0) & (F.col("until") > F.col("start")) & (F.col("until") <= F.col("n_chars"))
    known = known.withColumn("inside", F.coalesce(inside, F.lit(False)))
    touched = F.sequence(F.expr(f"int(start div {size})"), F.expr(f"int((until - 1) div {size})"))
    asked = known.where("inside").select(key, span, "start", "until", F.explode(touched).alias("block"))
    first: Column = F.greatest(F.col("start") - F.col("block") * size, F.lit(0))
    last = F.least(F.col("until") - F.col("block") * size, F.lit(size))
    pieces = asked.join(index.select(key, "block", "part"), [key, "block"]).select(span, "block", F.substring(F.col("part"), (first + 1).cast("int"), (last - first).cast("int")).alias("piece"))
    whole = pieces.groupBy(span).agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("pieces"))
    value = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    out = known.join(whole.select(span, value.alias("value")), span, "left")
    same = F.col("checksum").isNull() | (F.sha2(F.col("value").cast("binary"), 256) == F.col("checksum"))
    status = F.when(F.col("n_chars").isNull(), "unknown").when(~F.col("inside"), "out_of_range").when(same, "resolved").otherwise("changed")
    return out.withColumn("status", status).select(span, F.when(F.col("status") == "resolved", F.col("value")).alias("value"), "status")
