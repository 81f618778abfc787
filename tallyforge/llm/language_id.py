"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, every character that is no letter becomes a space, and
all 1- to 3-grams are hashed to 2^16 buckets. Learning sums bucket counts per
language over all rows (partial sums per partition, then one aggregate);
the log-probability matrix has languages x 2^16 floats, and a limit on the
number of languages keeps it a bounded broadcast. Scoring gathers the rows of
the matrix that a batch of texts hits and adds them up per text in numpy.

Defined results for odd input: null texts and texts without a letter are
``und`` with score 0; rows with a null language are never learned from; with
nothing learned every text is ``und``; ties go to the alphabetically first
language; repeated rows are learned from, and returned, each time. Only the
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, free

BUCKETS = 1 << 16
ORDERS = 3
MAX_LANGUAGES = 512
SMOOTHING = 0.5
CHUNK_CHARS = 1 << 20
UND = "und"


def letters_or_spaces(codes: np.ndarray) -> np.ndarray:
    """Code points with every one that is no letter replaced by a space."""
    low = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], np.uint32)
    out = low[np.minimum(codes, 0x24F)]
    far = np.flatnonzero(codes > 0x24F)
    if len(far):
        kinds, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([c if chr(c).isalpha() else 32 for c in kinds.tolist()], np.uint32)[at]
    return out


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams, an array (n-gram order x position); where each text starts; which texts have a letter.

    Every text is padded with two spaces in front, so no n-gram crosses texts.
    """
    padded = "".join(f"  {t.lower()}" for t in texts)
    lengths = np.array([len(t.lower()) + 2 for t in texts])
    codes = letters_or_spaces(np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32))
    starts = np.cumsum(lengths) - lengths
    has_letter = np.add.reduceat(codes != 32, starts) > 0
    # an n-gram ends at its position; the first two of a text look back into its own padding or at the text before, which the mask of spaces hides
    back1 = np.concatenate([codes[:1] * 0 + 32, codes[:-1]])
    back2 = np.concatenate([codes[:2] * 0 + 32, codes[:-2]])[: len(codes)]
    back2[starts[starts < len(back2)]] = 32
    back1[starts] = 32
    nxt = starts + 1
    back2[nxt] = 32
    hashed = codes * np.uint32(0x9E3779B1)
    out = np.empty((ORDERS, len(codes)), np.uint16)
    for n, before in enumerate((None, (back1, np.uint32(0x85EBCA6B)), (back2, np.uint32(0xC2B2AE35)))):
        if before is not None:
            hashed = hashed + (before[0] + np.uint32(n)) * before[1]
        mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[n] = mixed >> np.uint32(16)
    return out, starts, has_letter


def ngram_counts(text: str) -> tuple[np.ndarray, bool]:
    """How often each bucket occurs in one text, and whether it has a letter: piece by piece, so that memory is bounded."""
    text, counts, seen = text.lower(), np.zeros(BUCKETS, np.int64), False
    for at in range(0, len(text), CHUNK_CHARS):
        before = min(2, at)
        buckets, _, has_letter = ngram_buckets([text[at - before : at + CHUNK_CHARS]])
        # the padding counts once, and the characters before a piece were counted with it
        counts += np.bincount(buckets[:, 2 + before if at else 0 :].ravel(), minlength=BUCKETS)
        seen |= bool(has_letter[0])
    return counts, seen


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK_CHARS characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 2
        if size >= CHUNK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def count_ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bucket counts and number of texts by language, for one partition (bucket -1: texts)."""
    counts: dict[str, np.ndarray] = {}
    texts_of: dict[str, int] = {}
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            texts = texts.tolist()
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            texts_of[lang] = texts_of.get(lang, 0) + len(texts)
            for t in (t for t in texts if len(t) > CHUNK_CHARS):
                total += ngram_counts(t)[0]
            texts = [t for t in texts if len(t) <= CHUNK_CHARS]
            for a, b in chunks(texts):
                total += np.bincount(ngram_buckets(texts[a:b])[0].ravel(), minlength=BUCKETS)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": pd.Series([lang] * (len(at) + 1), dtype=object), "bucket": [-1, *at], "n": [texts_of[lang], *total[at]]})


class Model:
    """Languages and their (bucket x language) log-probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray, texts: np.ndarray):
        smoothed = counts + SMOOTHING
        self.languages = languages
        self.matrix = np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)
        self.prior = np.log(texts / max(1, texts.sum()))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the likeliest language, its posterior probability, and whether the text has a letter."""
        best, sure, seen = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
        for a, b in chunks([t if len(t) <= CHUNK_CHARS else "" for t in texts]):
            buckets, starts, has_letter = ngram_buckets([t if len(t) <= CHUNK_CHARS else "" for t in texts[a:b]])
            total = sum(np.add.reduceat(self.matrix[row], starts, axis=0, dtype=np.float64) for row in buckets) + self.prior
            for i in (i for i in range(a, b) if len(texts[i]) > CHUNK_CHARS):
                counts, has_letter[i - a] = ngram_counts(texts[i])
                total[i - a] = counts @ self.matrix.astype(np.float64) + self.prior
            top = total.argmax(axis=1)
            best.append(top)
            sure.append(1 / np.exp(total - total[np.arange(b - a), top][:, None]).sum(axis=1))
            seen.append(has_letter)
        return np.concatenate(best), np.concatenate(sure), np.concatenate(seen)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on all rows whose language and text are not null; None if there are none."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    summed = rows.mapInPandas(count_ngrams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row a language and bucket: bounded by MAX_LANGUAGES x BUCKETS, whatever the number of documents
    found = summed.toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the broadcast matrix is bounded to {MAX_LANGUAGES}")
    counts, texts = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    column = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    texts[column[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    return Model(languages, counts, texts)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the predicted language with its posterior probability; these replace columns of ``docs`` with their names."""
    sent = Shared(docs.sparkSession, model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        nb = sent.value
        for texts in batches:
            lang, sure = np.full(len(texts), UND, object), np.zeros(len(texts))
            if nb is not None and len(texts):
                best, p, has_letter = nb.score(texts.fillna("").tolist())
                lang[has_letter] = np.array(nb.languages, object)[best[has_letter]]
                sure[has_letter] = p[has_letter]
            yield pd.DataFrame({"lang": lang, "score": sure})

    [held] = free(docs, "language_id")
    return docs.withColumn(held, predict(F.col(text_col))).withColumns({lang_pred: F.col(f"{held}.lang"), score: F.col(f"{held}.score")}).drop(held)


def accepted(score: Column, lang_pred: Column) -> Column:
    """The filter of a corpus: a language was found, and is likelier than all others together."""
    return (lang_pred != UND) & (score >= 0.5)
