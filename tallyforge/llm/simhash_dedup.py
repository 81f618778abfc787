"""SimHash near-duplicates, linked exactly by a forest of vantage-point trees.

Fingerprints of at most ``radius`` differing bits differ in at most
radius // PARTS bits of one of PARTS equal parts. For each part there is a
vantage-point tree: a node holds a vantage fingerprint and a distance; what is
nearer goes to its inner branch, the rest to the outer one. By the triangle
inequality a branch can only hold a partner of a fingerprint whose own distance
lies within the part's radius of the boundary, so a fingerprint has one home
leaf and visits the leaves beyond boundaries that it is close to. Leaves are
shards: each compares its home rows with its home rows and visitors over all
64 bits, and reports a spanning forest of the links it finds, never all pairs.
The trees are grown on a bounded sample, which shapes the shards only; every
fingerprint is routed and every link is found.

Equal fingerprints are one row before anything is compared, so a large group of
copies adds one fingerprint. Components are joined by alternating stars.

Defined results for odd input: a null or wordless text has fingerprint zero and
is linked like any other; a null id keeps its fingerprint, counts as larger
than all ids for the component, and a component without ids has a null id;
repeated rows are returned each time. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, hash_sample, stored
from .components import components

SEED = 42
PARTS = 4
LEAF_ROWS = 2048
SAMPLE_ROWS = 65_536
MOST_SAMPLE = 1 << 20
LEAST_SAMPLE = 8
VANTAGES = 8
ALL_BITS = 0xFFFF_FFFF_FFFF_FFFF


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` lower-cased words, joined by spaces."""
    own = text.encode().lower().split()
    if len(own) <= words:
        joined = [b" ".join(own)] if own else []
    else:
        joined = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in joined], np.uint64)


def fingerprint(text: str, words: int = 4) -> int:
    """A bit is 1 if set in over half the shingles' hashes; 0 for no words."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, words: int = 4) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own = np.array([fingerprint(t or "", words) for t in texts], np.uint64)
            yield pd.Series(own.view(np.int64))

    return of(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Node:
    """A vantage fingerprint with a boundary, or a leaf."""

    def __init__(self, leaf: int | None = None, vantage: int = 0, mask: int = 0, reach: int = 0, boundary: int = 0, inner: Node | None = None, outer: Node | None = None):
        self.leaf, self.vantage, self.mask, self.reach, self.boundary, self.inner, self.outer = leaf, vantage, mask, reach, boundary, inner, outer


def distances(fps: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(vantage)) & np.uint64(mask))


class Forest:
    """The trees of all parts; leaves are numbered through."""

    def __init__(self, sample: np.ndarray, rows: int, radius: int, leaf_rows: int = LEAF_ROWS):
        self.leaves, self.radius = 0, radius
        self.rows_each = max(1.0, rows / max(1, len(sample)))
        self.leaf_rows = leaf_rows
        width = 64 // PARTS
        self.roots = [self._grow(sample, ((1 << width) - 1) << (width * i), np.random.default_rng(i)) for i in range(PARTS)]

    def _grow(self, sample: np.ndarray, mask: int, rng: np.random.Generator) -> Node:
        if len(sample) >= LEAST_SAMPLE and len(sample) * self.rows_each > self.leaf_rows:
            # the part's own bits; where they are all alike, all bits
            for bits, reach in ((mask, self.radius // PARTS), (ALL_BITS, self.radius)):
                best = None
                for vantage in rng.choice(sample, VANTAGES).tolist():
                    d = distances(sample, vantage, bits)
                    boundary = int(np.median(d))
                    for at in (boundary - 1, boundary):
                        inside = np.mean(d <= at)
                        if 0.2 <= inside <= 0.8:
                            near = np.mean(np.abs(d.astype(np.int64) - at - 0.5) <= reach)
                            cost = (near + 0.01) / -(inside * np.log2(inside) + (1 - inside) * np.log2(1 - inside))
                            if best is None or cost < best[0]:
                                best = (cost, vantage, at, d <= at)
                if best:
                    _, vantage, at, inner = best
                    return Node(None, vantage, bits, reach, at, self._grow(sample[inner], mask, rng), self._grow(sample[~inner], mask, rng))
        self.leaves += 1
        return Node(self.leaves - 1)

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, rows, whether they are at home there) for every leaf that a row has to be in."""
        todo = [(root, np.arange(len(fps)), np.zeros(0, np.int64)) for root in self.roots]
        while todo:
            node, home, visiting = todo.pop()
            if node.leaf is not None:
                if len(home):
                    yield node.leaf, home, True
                if len(visiting):
                    yield node.leaf, visiting, False
                continue
            d, v = (distances(fps[x], node.vantage, node.mask).astype(np.int64) for x in (home, visiting))
            to_outer = home[(d <= node.boundary) & (d > node.boundary - node.reach)]
            todo.append((node.inner, home[d <= node.boundary], visiting[v <= node.boundary + node.reach]))
            todo.append((node.outer, home[d > node.boundary], np.concatenate([to_outer, visiting[v > node.boundary - node.reach]])))


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in place; every set's root is its least member."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def leaf_links(radius: int, block: int = 256):
    """For a leaf: (a, b) longs, a spanning forest of its home rows' links."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("home", ascending=False)
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        at_home = int(pdf["home"].sum())
        parent = np.arange(len(fps))
        for i in range(0, at_home, block):
            differing = np.bitwise_count(fps[i : min(i + block, at_home), None] ^ fps[None, i:])
            a, b = np.nonzero(differing <= radius)
            unite(parent, a[a < b] + i, b[a < b] + i)
        linked = np.flatnonzero(parent != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[parent[linked]].view(np.int64)})

    return links


def linked_fingerprints(spark: SparkSession, distinct: DataFrame, radius: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(node, root) components of the distinct fingerprints ``fp`` that lie within ``radius`` bits."""
    return components(fingerprint_links(spark, distinct, radius, leaf_rows))


def fingerprint_links(spark: SparkSession, distinct: DataFrame, radius: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp``: a spanning forest of each leaf's pairs within ``radius`` bits, which together link all that lie so near."""
    rows = distinct.count()
    sample = hash_sample(distinct, ["fp"], min(MOST_SAMPLE, max(SAMPLE_ROWS, rows // 64))).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    forest = Forest(sample, rows, radius, leaf_rows)
    sent = Shared(spark, forest)  # at most 2 * PARTS * MOST_SAMPLE / LEAST_SAMPLE nodes

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64)
            for leaf, at, home in sent.value.route(fps.view(np.uint64)):
                yield pd.DataFrame({"leaf": np.full(len(at), leaf, np.int32), "fp": fps[at], "home": home})

    return distinct.mapInPandas(routed, "leaf int, fp long, home boolean").groupBy("leaf").applyInPandas(leaf_links(radius), "a long, b long")


def grouped(docs: DataFrame, words: int, radius: int, id_col: str, text_col: str, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, row_key, text_key, fp, component_id, root) of every row; root is the least fingerprint of its group."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col), *row_keys(id_col, text), fingerprints(F.col(text_col), words).alias("fp"))
    own = stored(own, "fingerprints")
    least = stored(own.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct")
    roots = linked_fingerprints(docs.sparkSession, least.select("fp"), radius, leaf_rows)
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.join(rooted.join(ids, "root").select("fp", "component_id", "root"), "fp")


def row_keys(id_col: str, text: Column) -> list[Column]:
    """Two hashes that tell rows apart by id and text."""
    return [F.xxhash64(F.col(id_col), text).alias("row_key"), F.xxhash64(F.lit(1), text).alias("text_key")]


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, fp as long, component_id) of every row: the least id that links of at most ``radius`` bits reach."""
    return grouped(docs, words, radius, id_col, text_col, leaf_rows).select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``docs`` with one row of each group: of least id (nulls last), then of least text hash; rows alike in both are one."""
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), "text_key", "row_key")).alias("first")
    kept = grouped(docs, words, radius, id_col, text_col, leaf_rows).groupBy("root").agg(first).select(F.col("first.row_key").alias("__row_key"), F.col("first.text_key").alias("__text_key"))
    row_key, text_key = row_keys(id_col, F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumns({"__row_key": row_key, "__text_key": text_key})
    keys = ["__row_key", "__text_key"]
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
