"""Toxic passages: maximum-scoring segments over token log-odds.

A token is a word or one of its leading parts of 3 to 7 letters, so that a stem
counts in all its inflections and compounds. Learning counts, by class, the
labelled texts that hold a token. A token's log-odds between the classes get an
informative Dirichlet prior (its count over both classes, scaled down by
PRIOR_SHARE and split by the classes' shares, so that it shrinks towards zero),
and only those whose z-score clears the universal threshold sqrt(2 ln m) for m
tokens tried count. A word scores the best of its tokens; any other word costs a small
drift, so that the expected score of clean text is negative. A linear scan then finds all maximal segments of a text, each a
passage whose score no extension or trimming improves. Under clean text segment
scores follow an extreme-value law: with lambda the positive root of
sum p(w) exp(lambda s(w)) = 1, a text of n words holds K n exp(-lambda S)
segments of score S or more by chance. Segments expected less than MOST_EXPECTED
times are the toxic passages. A logistic curve over the best and the summed
normalised scores, fitted on the labelled texts, turns them into a probability.

Fitting reads a bounded sample of the labelled rows (FIT_ROWS, those with the
least hash of the id), so the word table is bounded too; scoring covers every
word of every text.

Defined results for odd input: null and empty texts have no passages and get
the curve's value for that; without labels of both classes every score is the
share of toxic labels (0.0 without any); labels other than 0 and 1, null ones too, are ignored; repeated
rows are learned from, and returned, each time. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared

FIT_ROWS = 20_000
PRIOR_SHARE = 0.1
LEAST_TEXTS = 5
PREFIXES = range(3, 8)
CACHED_WORDS = 100_000
#: A task hands on its counts when it has met so many tokens.
COUNTED_TOKENS = 50_000
DRIFT = 0.05
MOST_EXPECTED = 0.05
K = 0.1
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(begin, end, score) of all maximal scoring segments, in linear time.

    Only positive scores can begin or extend a segment, so the scan walks those
    and takes the sums between them from a running total. Candidates are kept
    with the totals on their left and right; a new one is merged with the last
    whose left total is lower, if that one's right total is lower as well.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # begin, end, left, right, the last candidate with a lower left
    for i in np.flatnonzero(scores > 0).tolist():
        begin, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((begin, end, left, right, j))
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, r - lo) for b, e, lo, r, _ in stack]


def tokens_of(word: str) -> set[str]:
    """A word, marked as whole, and its leading parts."""
    return {f"{word} ", *(word[:n] for n in PREFIXES if n <= len(word))}


def log_odds(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Tokens with significant log-odds of the toxic class, by an informative Dirichlet prior; counts are of texts."""
    out = {}
    z_least = np.sqrt(2 * np.log(max(2, sum(seen >= LEAST_TEXTS for seen in toxic.values()))))
    for token, seen in toxic.items():
        if seen < LEAST_TEXTS:
            continue
        prior = PRIOR_SHARE * (seen + clean[token]) / (n_toxic + n_clean)  # by each class's share: alone, it gives no odds
        in_toxic, in_clean = seen + prior * n_toxic, clean[token] + prior * n_clean
        size = 1 + PRIOR_SHARE
        cells = np.array([in_toxic, n_toxic * size - in_toxic + 1, in_clean, n_clean * size - in_clean + 1])
        delta = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
        if delta / np.sqrt((1 / cells).sum()) >= z_least:
            out[token] = float(delta)
    return out


def decay(weights: dict[str, float], clean: Counter, clean_words: int) -> float:
    """lambda: the positive root of the sum over clean text of p(w) exp(lambda s(w)) = 1."""
    total = clean_words + 1.0
    words = list(weights)
    p = np.array([(clean[w] + 1.0 / (len(words) + 1)) / total for w in words])
    p /= max(1.0, 2 * p.sum())
    s = np.array([weights[w] for w in words])
    rest = 1 - p.sum()
    low, high = 0.0, 1.0
    excess = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + rest * np.exp(-x * DRIFT) - 1)
    while excess(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None
    cache: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        """The score of a word, remembered for a bounded number of words."""
        if (known := self.cache.get(word)) is None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            known = self.cache[word] = max((self.weights[t] for t in tokens_of(word) if t in self.weights), default=-DRIFT)
        return known

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words; (begin, end, normalised score) of all maximal segments, in words."""
        words = words_of(text)
        scores = np.fromiter(map(self.weight, words), float, len(words))
        if not len(words) or scores.max() <= 0:
            return len(words), []
        chance = np.log(K * len(words) + 1)
        return len(words), [(b, e, self.decay * s - chance) for b, e, s in maximal_segments(scores)]

    def significant(self, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        return [x for x in segments if x[2] >= -np.log(MOST_EXPECTED)]

    def features(self, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        """The best normalised score, cut to a range, and the log of the sum of the significant ones."""
        best = max((x[2] for x in segments), default=-10.0)
        return min(max(best, -10.0), 30.0) / 10, float(np.log1p(sum(x[2] for x in self.significant(segments))))

    def score(self, features: tuple[float, float]) -> float:
        if self.constant is not None:
            return self.constant
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * features[0] + c * features[1], -30, 30))))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression of y on two features by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + ridge * np.eye(len(beta)), gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows of ``labels`` (at most ``fit_rows``) and their texts in ``docs``."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.where("label IN (0, 1)").orderBy(F.xxhash64("id"), "id", "label").limit(fit_rows).toPandas()  # bounded by fit_rows
    if chosen.empty:
        return Model(constant=0.0)
    if chosen["label"].nunique() < 2:
        return Model(constant=float(chosen["label"].iloc[0]))
    kind = labels.schema[id_col].dataType
    chosen = spark.createDataFrame(chosen.drop_duplicates("id", keep="last"), T.StructType([T.StructField("id", kind), T.StructField("label", T.IntegerType())]))
    # the labelled rows are at most fit_rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("text", "label")

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int]]:
        for pdf in batches:
            yield from zip(pdf["text"].tolist(), pdf["label"].tolist(), strict=True)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts of each class that hold a token, for parts of the sample; under no token: texts, and words as ``n``."""
        by_class, texts, words = (Counter(), Counter()), [0, 0], 0

        def counted(totals: list[int]) -> pd.DataFrame:
            tokens = list(by_class[0] | by_class[1])
            clean, toxic = ([by_class[i][t] for t in tokens] for i in (0, 1))
            return pd.DataFrame({"token": pd.Series([*tokens, None], dtype=object), "clean": [*clean, totals[0]], "toxic": [*toxic, totals[1]], "n": [*([0] * len(tokens)), totals[2]]})

        for text, label in labelled(batches):
            own = words_of(text)
            by_class[label].update({t for w in set(own) for t in tokens_of(w)})
            texts[label] += 1
            words += len(own) * (1 - label)
            if len(by_class[0]) + len(by_class[1]) > COUNTED_TOKENS:
                yield counted([0, 0, 0])
                by_class[0].clear(), by_class[1].clear()
        yield counted([*texts, words])

    sums = rows.mapInPandas(count, "token string, clean long, toxic long, n long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "n")))
    # tokens of several toxic texts of the bounded sample, and the row of totals
    found = sums.where(f"token IS NULL OR toxic >= {LEAST_TEXTS}").toPandas()
    totals = found[found["token"].isna()].sum(numeric_only=True)
    found = found.dropna(subset="token")
    toxic, clean = (Counter(dict(zip(found["token"], found[c].astype(int), strict=True))) for c in ("toxic", "clean"))
    weights = log_odds(toxic, clean, int(totals["toxic"]), int(totals["clean"]))
    model = Model(weights, decay(weights, clean, int(totals["n"])) if weights else 1.0)
    weighted = Shared(spark, model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [(*weighted.value.features(weighted.value.passages(text)[1]), label) for text, label in labelled(batches)]
        yield pd.DataFrame(found, columns=["best", "summed", "label"])

    points = rows.mapInPandas(measure, "best double, summed double, label int").toPandas()  # at most a row for each row fitted on
    if points["label"].nunique() < 2:
        model.constant = float(points["label"].mean()) if len(points) else 0.0
    else:
        model.curve = fit_curve(points[["best", "summed"]].to_numpy(), points["label"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` and a struct: score, predicted, passages (begin, end, normalised score, the words' text). A column of ``docs`` named ``out`` is replaced."""
    sent = Shared(docs.sparkSession, model)

    @F.pandas_udf("score double, predicted int, passages array<struct<begin:int,end:int,score:double>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            rows = []
            for text in texts:
                segments = own.passages(text or "")[1]
                p = own.score(own.features(segments))
                rows.append((p, int(p >= THRESHOLD), [{"begin": b, "end": e, "score": float(s)} for b, e, s in own.significant(segments)]))
            yield pd.DataFrame(rows, columns=["score", "predicted", "passages"])

    return docs.withColumn(out, apply(F.col(text_col)))
