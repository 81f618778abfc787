"""Near-duplicates by exact Jaccard similarity of shingle sets; candidates come from SimHash fingerprints in vantage-point trees and from bands of min-hashes.

0. Sets whose fingerprints differ in RADIUS bits or fewer, found by the forest of vantage-point trees of ``simhash_dedup``,
   are candidates, as are sets of one fingerprint. Pairs of a similarity near the least often lie farther apart; those are left to 1.
1. A text's sketch has BANDS * ROWS min-hashes of its set of word shingles. Two
   sets of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: all
   but 1.2e-7 of the pairs of similarity 0.8 meet, and fewer above are missed.
2. Texts with equal sets are one set. Every member of a band's bucket is compared
   with its middle, the member that meets the most others over all its buckets,
   which links large groups with few pairs and mostly one middle. Sets of buckets
   that still hold several components are then compared
   where they share one of their rarest shingles, as all similar pairs do. So every
   similar pair that shares a band is compared or already linked.
3. A comparison counts the shingles shared, in joins: only sets of candidates are
   built, and a set that many are compared with is dealt out by the other's hash.

Defined results for odd input: null and wordless texts have the empty set and are
alike; a text of fewer words than a shingle is one shingle; null ids come last;
repeated rows are one. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import free, stored
from .components import components
from .simhash_dedup import fingerprint_of, row_keys, shingle_hashes

WORDS = 5
TENTHS = 8  # least similarity, in tenths
RADIUS = 7  # differing bits; each quarter's tree is searched one bit around, as for 4
BANDS = 40
ROWS = 5
COLUMNS = 512
DEALT = 32
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_FACTOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_JOIN = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", words))


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """One long for each band; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), COLUMNS):
        np.minimum(least, ((shingles[None, i : i + COLUMNS] ^ _XOR) * _FACTOR).min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    joined = (least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64)
    return ((joined ^ (joined >> np.uint64(32))) * _FACTOR[0] ^ _BAND).view(np.int64)


def sketches(text: Column, words: int) -> Column:
    """A struct of the set's key, its size, its bands and its fingerprint."""

    @F.pandas_udf("node long, size int, bands array<long>, fp long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, words) for t in texts]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"node": keys, "size": [len(s) for s in sets], "bands": [band_hashes(s) for s in sets], "fp": np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)})

    return of(text)


def shingles_of(words: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["node"]].assign(shingles=[shingle_set(t, words).view(np.int64) for t in pdf["text"]])

    return sets


def alike(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Those of the (a, b) ``pairs`` whose sets have a Jaccard similarity of ``tenths`` or more."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(DEALT)))
    left = dealt.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    right = dealt.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return right.join(left, ["a", "part"]).where((10 + tenths) * shared >= tenths * (F.size("sa") + F.size("sb"))).select("a", "b")


def near_fingerprints(distinct: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of the sets (node, fp): each with the least of its fingerprint, and those with the ones that the trees link them to."""
    first = stored(distinct.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    links = simhash_dedup.fingerprint_links(distinct.sparkSession, first.select("fp"), radius)
    of = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_node"))
    far = links.distinct().join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("x"), F.col("b_node").alias("y"))
    same = distinct.join(first, "fp").where("node <> first").select(F.col("node").alias("x"), F.col("first").alias("y"))
    return far.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def sharing_rare_shingles(nodes: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Pairs (a, b) of different roots among ``nodes`` (node, root): all that can have the similarity, and few others.

    With the shingles of each set in one order, rarest first, two sets share no more
    than either has from the first shared one on. So that one is among the first
    size - ceil(tenths / 10 * size) + 1 of both. Shared passages that fill less of
    the sets than the similarity asks for come after it. The commonest root of a
    shingle isn't paired with itself, so a large linked group costs its size.
    """
    own = sets.join(nodes, "node").select("node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    counts = own.groupBy("shingle").agg(F.count("*").alias("n"))
    ordered = own.join(counts, "shingle").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("order"))
    least = F.ceil(F.col("size") * F.lit(tenths) / 10).cast("int")
    first = ordered.select("node", "root", "size", F.posexplode(F.slice("order", F.lit(1), F.col("size") - least + 1)).alias("at", "key"))
    keys = stored(first.where("key.n > 1").select("node", "root", "size", "at", F.col("key.shingle").alias("shingle")), "rare")

    shares = keys.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"))
    main = shares.where("roots > 1").select("shingle", F.col("most.root").alias("main"))
    r = keys.join(main, "shingle")
    l, r = r.where("root <> main").alias("l"), r.alias("r")  # noqa: E741
    once = (F.col("l.root") < F.col("r.root")) | ((F.col("r.root") == F.col("r.main")) & (F.col("l.root") > F.col("r.root")))
    most = F.least(F.col("l.size") - F.col("l.at"), F.col("r.size") - F.col("r.at"))
    can = (10 + tenths) * most >= tenths * (F.col("l.size") + F.col("r.size"))
    met = l.join(r, (F.col("l.shingle") == F.col("r.shingle")) & once & can)
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def linked_sets(docs: DataFrame, sketched: DataFrame, words: int, tenths: int, text_col: str, id_col: str) -> DataFrame:
    """(node, root) of the sets that aren't their component's root."""
    distinct = stored(sketched.groupBy("node", "size").agg(F.min("row_key").alias("row_key"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "sets")
    near = stored(near_fingerprints(distinct.where("size > 0").select("node", "fp"), RADIUS), "near")
    placed = distinct.select(F.explode("bands").alias("bucket"), "node", "size")
    met = stored(placed.join(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "met")
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    middles = met.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("middle")).select("bucket", F.col("middle.node").alias("middle"))

    paired = met.select("node").union(near.select("a")).union(near.select("b")).distinct()
    concerned = distinct.join(paired, "node", "left_semi").select("node", "row_key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(row_keys(id_col, text)[0], text.alias("text")).join(concerned, "row_key").select("node", "text")
    sets = stored(texts.mapInPandas(shingles_of(words), "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")

    stars = met.join(middles, "bucket").select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b")).where("a <> b").unionByName(near).distinct()
    links = stored(alike(stars, sets, tenths), "stars")
    roots = components(links)

    rooted = met.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
    open_sets = rooted.join(several, "bucket").select("node", "root").distinct()
    rest = stored(sharing_rare_shingles(open_sets, sets, tenths), "rest")
    return components(links.unionByName(alike(rest.join(stars, ["a", "b"], "left_anti"), sets, tenths)))


def grouped(docs: DataFrame, words: int = WORDS, tenths: int = TENTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, text_key, root) of every row; links of a similarity of ``tenths`` or more reach all rows of a root."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text), sketches(text, words).alias("sketch"))
    own = stored(own.select("id", "row_key", "text_key", "sketch.*"), "sketches")
    roots = linked_sets(docs, own, words, tenths, text_col, id_col)
    return own.join(roots, "node", "left").select("id", "row_key", "text_key", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, words: int = WORDS, tenths: int = TENTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: of least id (nulls last), then of least text hash; rows alike in both are one."""
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), "text_key", "row_key")).alias("first")
    keys = free(docs, "row_key", "text_key")
    kept = grouped(docs, words, tenths, id_col, text_col).groupBy("root").agg(first).select(*(F.col(f"first.{c}").alias(k) for c, k in zip(("row_key", "text_key"), keys, strict=True)))
    own = row_keys(id_col, F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumns(dict(zip(keys, own, strict=True))).join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
