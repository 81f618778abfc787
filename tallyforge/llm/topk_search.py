"""Exact top-k inner-product search by MaxScore.

A vector component is a term, its integer value the weight of its posting; a
zero is an absent posting. Rows are dealt into shards, queries into blocks,
and every (shard, block) cell answers its queries with MaxScore: the terms of
a query are ordered by the highest contribution that the shard's postings
allow, the essential ones (those whose removal would leave a sum of bounds
below the k-th best score known) are traversed in full, and the rest are only
probed for rows that can still enter the top k. A window merges the shards.

Defined results for odd input:
- a vector that is null, or holds a null or non-finite component, or one that
  is beyond double range after scaling, takes no part, as query or candidate;
- an empty table gives no rows; shorter vectors count as zero-padded;
- ties in score go to the smaller id; a repeated candidate row is a candidate
  each time; an exactly repeated query row is answered once; rows that share
  the query's id are never its candidates; a null id is never a query;
- only the id and vector columns are read, so other columns cannot clash;
- scores beyond the range of a long are clamped to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
QUERY_ROWS = 1024
TERM_GROUP = 8
SCALE = 64.0


def integer_matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(64 x) of each component as double, zero-padded to ``width``."""
    out = np.zeros((len(vectors), width))
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    if len(vectors) and (lengths == width).all():
        out[:] = np.vstack(vectors.to_numpy())
    else:
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    return np.floor(out * SCALE)


def _kth_best(scores: np.ndarray, k: int) -> float:
    return -np.inf if len(scores) < k else np.partition(scores, len(scores) - k)[len(scores) - k]


def maxscore(query: np.ndarray, own: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best rows of a shard for one query.

    postings: term-major weights (terms x rows); high, low: the extreme
    weights of each term, zero included as the weight of an absent posting;
    own: mask of rows that the query may not find.
    """
    bound = np.maximum(query * high, query * low)
    order = np.argsort(-bound, kind="stable")
    order = order[query[order] != 0]
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
    rows = postings.shape[1]
    score = np.zeros(rows, postings.dtype)
    allowed = ~own
    least, done = -np.inf, 0
    while done < len(order) and rest[done] >= least:  # essential terms
        terms = order[done : done + TERM_GROUP]
        score += query[terms] @ postings[terms]
        done += len(terms)
        if done < len(order):
            seeds = np.flatnonzero(allowed)
            if len(seeds) > k:
                seeds = seeds[np.argpartition(-score[seeds], k - 1)[:k]]
            left = order[done:]
            least = max(least, _kth_best(score[seeds] + query[left] @ postings[np.ix_(left, seeds)], k))
    alive = np.flatnonzero(allowed)
    while done < len(order):  # the others, while a row is competitive
        alive = alive[score[alive] + rest[done] >= least]
        terms = order[done : done + TERM_GROUP]
        score[alive] += query[terms] @ postings[np.ix_(terms, alive)]
        done += len(terms)
    found = score[alive]
    if len(alive) > k:
        keep = found >= _kth_best(found, k)
        alive, found = alive[keep], found[keep]
    best = np.lexsort((ids[alive], -found))[:k]
    return alive[best], found[best]


def _maxscore_exact(query: list[int], rows: np.ndarray, own: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """For weights beyond exact doubles: Python integers, every row."""
    alive = np.flatnonzero(~own)
    scores = {i: sum(a * int(b) for a, b in zip(query, rows[i], strict=True)) for i in alive.tolist()}
    best = sorted(scores, key=lambda i: (-scores[i], ids[i]))[:k]
    return np.array(best, np.int64), [scores[i] for i in best]


def search_cell(k: int):
    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["is_query"].to_numpy(bool)
        docs, queries = pdf[~asks], pdf[asks]
        out: dict[str, list] = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
        if len(docs) and len(queries):
            width = max(map(len, pdf["v"]))
            rows, wanted = integer_matrix(docs["v"], width), integer_matrix(queries["v"], width)
            null_ids = docs["vec_id"].isna().to_numpy()
            ids = docs["vec_id"].fillna(-(2**63)).astype("int64").to_numpy()
            # the sum of |q||d| bounds every partial sum: below 2^24 and 2^53 floats are exact
            most = np.abs(rows).max(initial=0) * np.abs(wanted).max(initial=0) * max(1, width)
            exact = np.float32 if most < 2**24 else np.float64 if most < 2**53 else None
            postings = np.ascontiguousarray(rows.T, exact or np.float64)
            high, low = postings.max(axis=1).clip(0), postings.min(axis=1).clip(None, 0)
            for q, query_id, key in zip(wanted, queries["vec_id"].to_numpy(), queries["query_key"].to_numpy(), strict=True):
                own = (ids == query_id) & ~null_ids
                if exact:
                    at, found = maxscore(q.astype(exact), own, postings, high, low, k, ids)
                    found = found.astype(np.int64).tolist()
                else:
                    at, found = _maxscore_exact([int(x) for x in q], rows, own, k, ids)
                    found = [min(max(x, -(2**63)), 2**63 - 1) for x in found]
                out["query_id"] += [query_id] * len(at)
                out["query_key"] += [key] * len(at)
                out["vec_id"] += [None if null_ids[i] else int(ids[i]) for i in at]
                out["score"] += found
        return pd.DataFrame(out).astype({"query_id": "int64", "query_key": "int64", "vec_id": "Int64", "score": "int64"})

    return cell


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of ``vectors`` that ``is_query`` marks."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.where(F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    counts = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = -(-counts[0] // shard_rows) or 1, -(-counts[1] // query_rows) or 1
    at = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = F.xxhash64("v").alias("query_key")
    docs = rows.select(F.lit(False).alias("is_query"), "vec_id", key, "v", at(shards).alias("shard"), every(blocks).alias("block"))
    queries = rows.where("asks AND vec_id IS NOT NULL").dropDuplicates(["vec_id", "v"]).select(F.lit(True).alias("is_query"), "vec_id", key, "v", every(shards).alias("shard"), at(blocks).alias("block"))
    cells = docs.unionByName(queries).groupBy("shard", "block")
    found = cells.applyInPandas(search_cell(k), "query_id long, query_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["exact_topk", "maxscore"]
