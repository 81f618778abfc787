"""Removal of passages of over 50 words that repeat, by the suffix array of suffix_dedup over coded words.

Each word (a run of other than white space) is coded by the WIDTH bytes of its
hash, so that 51 equal words are a repeated string of 51 * WIDTH bytes and, but for
hash collisions, nothing else is. Texts are coded in the workers that read them.
Spans are rounded to whole words. A text without white space is one word. Equal
texts are copies and go whole, if they have the length; null texts stay null; an
empty table gives no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free
from .suffix_dedup import merged, repeated_passages

LEAST_WORDS = 51
WIDTH = 8
GRAM = 16 * WIDTH
CACHED_WORDS = 100_000
WORD = re.compile(r"\S+")


class WordCodes(dict):
    """The hash of each word, for a bounded number of words at a time."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = code = xxhash.xxh64_digest(word.encode())
        return code


def coder():
    codes: list[WordCodes] = []

    def code(text: str) -> bytes:
        if not codes:
            codes.append(WordCodes())
        return b"".join(map(codes[0].__getitem__, text.split()))

    return code


def without(text: str, spans: list[dict], words: int) -> str:
    """The text without the words that the spans of its code cover, and the white space after them."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    size = (len(starts) - 1) * WIDTH
    inside = [(s["length"], s["begin"], min(s["end"], size)) for s in spans]
    whole = [{"length": words, "begin": -(-b // WIDTH), "end": e // WIDTH} for n, b, e in inside if n or e - b >= words * WIDTH]
    runs = merged(whole, words)
    return "".join(text[a:b] for a, b in zip([0, *(starts[r[1]] for r in runs)], [*(starts[r[0]] for r in runs), len(text)], strict=True))


def rewritten(docs: DataFrame, words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages of ``words`` or more words that start anywhere else as well."""
    copies, spans = repeated_passages(docs, (words * WIDTH,), gram=GRAM, id_col=id_col, text_col=text_col, code=coder())
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    cut = spans.select("k1", "k2", "spans").unionByName(copies.where(F.col("words") >= words).select("k1", "k2", none))
    k1, k2, found, t1, t2 = free(docs, "k1", "k2", "spans", "t1", "t2")
    cut = cut.withColumnsRenamed({"k1": k1, "k2": k2, "spans": found})

    @F.pandas_udf("string")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([without(t, s, words) if s is not None and len(s) else t for t, s in zip(texts, found, strict=True)], dtype=object)

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumns({t1: F.xxhash64(text), t2: F.xxhash64(F.lit(1), text)})
    out = own.join(cut, (F.col(t1) == F.col(k1)) & (F.col(t2) == F.col(k2)), "left")
    whole = F.col(k1).isNotNull() & F.col(found).isNull()
    return out.withColumn(text_col, F.when(whole, F.lit("")).otherwise(keep(F.col(text_col), F.col(found)))).select(*docs.columns)
