"""Token-id shards with keyed access through minimal perfect hashing.

Writing: rows are range-partitioned by key (and a hash of the text, so that one
key's documents can be split) and sorted, so shards follow key order. Each task
tokenizes its rows and emits segments of about SEGMENT_TOKENS ids: the raw ids
(unsigned little-endian, 16 bits if the vocabulary allows, else 32) with the keys
in order and the offset of each document. Segments are rows of a Parquet folder,
written by Spark's own committer: any store Spark can write will do, and a lost
executor's attempt leaves nothing behind.

The index is a second folder, of parts of about INDEX_KEYS keys each, dealt out by
a hash of the key. A part holds a minimal perfect hash of its keys: levels of bit
vectors, where a key takes the first level whose bit it alone hashes to; the
rank of the bit is the key's slot, which holds a fingerprint (to turn away keys
that are not there) and the places of its documents (shard, segment, first and last
document). A third, small folder is the manifest: a row for each part of the payload
with the number of ids before it, and one with the number of index parts. A keyed access
reads that number, the index parts of its keys (the index lies in order of the parts, so a
scan skips the others), and the segments that those name: a hash or two, a rank and a
slice of one segment, whatever the size of the corpus.

Defined results for odd input: a null or empty text is a document of the end id
alone; null keys come first and are in no index; repeated keys share a slot that
spans all their documents, in order of a hash of the text; an empty table writes
empty folders, which read as no rows. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, shuffle_partitions, stored
from .vocabularies import Lazy

SEGMENT_TOKENS = 1 << 18
INDEX_KEYS = 1 << 18
PART_BYTES = 64 << 20
BATCH_TEXTS = 256
LOAD = 1.7
MOST_FILTERED = 1000
PAYLOAD = "part int, segment int, before long, n_docs long, n_tokens long, width int, nulls int, keys binary, offsets binary, ids binary"
MANIFEST = "part int, base long, n_docs long, shards int"
#: A manifest of so many rows (16 bytes each) is sent to all tasks; a larger one is joined.
MOST_SENT = 1 << 21
INDEX = "shard int, level_sizes array<long>, bits binary, fingerprints binary, spans binary, places binary"


def key_hash(keys: np.ndarray, level: int) -> np.ndarray:
    """splitmix64 of the key, shifted by the level."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFF_FFFF_FFFF_FFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (key_hash(keys, 1 << 20) >> np.uint64(48)).astype("<u2")


class PerfectHash:
    """Slots 0..n-1 of n distinct keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        """sizes: of the levels, multiples of 64; bits: all levels as bytes."""
        self.sizes = sizes
        self.bits = bits
        counts = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            size = max(64, -(-int(LOAD * len(left)) // 64) * 64)
            at = (key_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that isn't there gets some slot, or -1."""
        out = np.full(len(keys), -1)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (key_hash(keys[todo], level) % np.uint64(size)).astype(np.int64) + base
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            found = at[hit]
            word = self.bits.view(np.uint64)[found >> 6]
            below = word & ((np.uint64(1) << (found & 63).astype(np.uint64)) - np.uint64(1))
            out[todo[hit]] = self.before[found >> 6] + np.bitwise_count(below)
            todo, base = todo[~hit], base + size
        return out


def segment_row(part: int, number: int, before: int, keys: list[int | None], documents: list[bytes], width: int) -> dict:
    """A segment of documents (ids as 32-bit little-endian bytes) in key order, nulls first."""
    nulls = keys.count(None)
    offsets = np.cumsum([0, *(len(d) // 4 for d in documents)], dtype="<i8")
    ids = np.frombuffer(b"".join(documents), "<u4")
    return {
        "part": part, "segment": number, "before": before, "n_docs": len(keys), "n_tokens": len(ids), "width": width, "nulls": nulls,
        "keys": np.array([0] * nulls + keys[nulls:], "<i8").tobytes(), "offsets": offsets.tobytes(), "ids": ids.astype("<u2" if width == 2 else "<u4").tobytes(),
    }


class Segment:
    """A segment read back."""

    def __init__(self, row):
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.data, self.width = memoryview(row["ids"]), row["width"]

    def document(self, i: int) -> np.ndarray:
        own = self.data[self.offsets[i] * self.width : self.offsets[i + 1] * self.width]
        return np.frombuffer(own, "<u2" if self.width == 2 else "<u4").astype("<u4")


def key_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, part, segment, first, last): the documents of each key in each segment."""
    for pdf in batches:
        for row in pdf.to_dict("records"):
            own = np.frombuffer(row["keys"], "<i8")[row["nulls"] :]
            if not len(own):
                continue
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            last = np.append(first[1:], len(own))
            yield pd.DataFrame({"key": own[first], "part": row["part"], "segment": row["segment"], "first": (first + row["nulls"]).astype(np.int32), "last": (last + row["nulls"]).astype(np.int32)})


def index_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """The index of the keys of one shard."""
    pdf = pdf.sort_values(["key", "part", "segment"])
    keys = pdf["key"].to_numpy(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    distinct = keys[first]
    index = PerfectHash.build(distinct)
    slot = index.slot(distinct)
    spans, marks = np.zeros((len(distinct), 2), "<i4"), np.zeros(len(distinct), "<u2")
    spans[slot] = np.column_stack([first, np.append(first[1:], len(keys))])
    marks[slot] = fingerprint(distinct)
    places = pdf[["part", "segment", "first", "last"]].to_numpy("<i4")
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "level_sizes": index.sizes, "bits": index.bits.tobytes(), "fingerprints": marks.tobytes(), "spans": spans.tobytes(), "places": np.ascontiguousarray(places).tobytes()}])


def find_places(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """(key, part, segment, first, last) of the asked keys whose fingerprint is in the index."""
    out = pd.DataFrame({"key": np.zeros(0, np.int64), **{c: np.zeros(0, np.int32) for c in ("part", "segment", "first", "last")}})
    for row in index.to_dict("records") if len(asked) else ():
        keys = asked["key"].to_numpy(np.int64)
        slot = PerfectHash([int(x) for x in row["level_sizes"]], np.frombuffer(row["bits"], np.uint8)).slot(keys)
        known = (slot >= 0) & (np.frombuffer(row["fingerprints"], "<u2")[slot] == fingerprint(keys))
        span = np.frombuffer(row["spans"], "<i4").reshape(-1, 2)[slot[known]]
        n = span[:, 1] - span[:, 0]
        at = np.repeat(span[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())
        places = np.frombuffer(row["places"], "<i4").reshape(-1, 4)[at]
        out = pd.DataFrame({"key": np.repeat(keys[known], n), **{c: places[:, j] for j, c in enumerate(("part", "segment", "first", "last"))}})
    return out


def shard_of(key, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")


def write_shards(docs: DataFrame, vocabulary: Lazy, end_id: int, path: str, vocabulary_size: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each with the end id, in ascending key order, and the index of the keys."""
    spark = docs.sparkSession
    sent = Shared(spark, vocabulary)
    width = 2 if vocabulary_size <= 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, before, keys, documents, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for pdf in batches:
            own, texts, null = pdf["key"].tolist(), pdf["text"].tolist(), pdf["no_key"].tolist()
            for at in range(0, len(own), BATCH_TEXTS):
                some = slice(at, at + BATCH_TEXTS)
                for key, ids, none in zip(own[some], sent.value.encoded(texts[some]), null[some], strict=True):
                    keys.append(None if none else key)
                    documents.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT_TOKENS:
                        yield pd.DataFrame([segment_row(part, number, before, keys, documents, width)])
                        number, before, keys, documents, size = number + 1, before + size, [], [], 0
        if keys:
            yield pd.DataFrame([segment_row(part, number, before, keys, documents, width)])

    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    key = F.col(id_col).cast("long")
    rows = docs.select(key.isNotNull().alias("keyed"), key.alias("own"), F.xxhash64(text).alias("hash"), text.alias("text"))
    order = ["keyed", "own", "hash"]
    ordered = rows.repartitionByRange(max(shuffle_partitions(spark), -(-size // PART_BYTES)), *order).sortWithinPartitions(*order)
    ordered.select(F.coalesce("own", F.lit(0)).alias("key"), (~F.col("keyed")).alias("no_key"), "text").mapInPandas(write, PAYLOAD).write.parquet(f"{path}/payload")

    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    parts = payload.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.sum("n_docs").alias("n_docs"))
    shards = max(1, -(-(parts.agg(F.sum("n_docs")).first()[0] or 0) // INDEX_KEYS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    manifest = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n_docs", F.lit(None).cast("int").alias("shards"))
    manifest.unionByName(spark.createDataFrame([(-1, 0, 0, shards)], MANIFEST)).coalesce(1).write.parquet(f"{path}/manifest")
    runs = payload.select("part", "segment", "nulls", "keys").mapInPandas(key_runs, "key long, part int, segment int, first int, last int")
    built = runs.withColumn("shard", shard_of("key", shards)).groupBy("shard").applyInPandas(index_part, INDEX)
    stored(built, "index").repartitionByRange(min(shards, shuffle_partitions(spark)), "shard").sortWithinPartitions("shard").write.parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files."""
    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    bases = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where("part >= 0").select("part", "base")
    whole = payload.join(F.broadcast(bases) if bases.count() <= MOST_SENT else bases, "part")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                segment = Segment(row)
                n, offsets = row["n_docs"], segment.offsets
                crc = [zlib.crc32(segment.document(i)) for i in range(n)]
                out = pd.DataFrame({"id": pd.array(segment.keys, "Int64"), "start": offsets[:-1] + row["before"] + row["base"], "n_tokens": np.diff(offsets), "ids_crc32": crc})
                out.loc[: row["nulls"] - 1, "id"] = pd.NA
                yield out

    return whole.mapInPandas(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def lookup(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of the documents of ``keys``: a key's index part gives its segments, whose slices are read."""
    payload, index = spark.read.schema(PAYLOAD).parquet(f"{path}/payload"), spark.read.schema(INDEX).parquet(f"{path}/index")
    shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where("part = -1").first()["shards"]
    wanted = keys.select(F.col(id_col).cast("long").alias("key")).where("key IS NOT NULL").distinct().withColumn("shard", shard_of("key", shards))
    asked = [r[0] for r in wanted.select("shard").distinct().limit(MOST_FILTERED + 1).collect()]
    if len(asked) <= MOST_FILTERED:  # few index parts: the scan leaves out the others
        index = index.where(F.col("shard").isin(asked))
    places = index.join(wanted.select("shard").distinct(), "shard", "left_semi").groupBy("shard").cogroup(wanted.groupBy("shard")).applyInPandas(find_places, "key long, part int, segment int, first int, last int")

    def fetch(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records") if len(asked) else ():
            segment = Segment(row)
            for key, a, b in zip(asked["key"].tolist(), asked["first"].tolist(), asked["last"].tolist(), strict=True):
                if segment.keys[a] == key:  # settles what a fingerprint leaves open
                    out += [(key, segment.document(i).astype(np.int64).tolist()) for i in range(a, b)]
        return pd.DataFrame(out, columns=["id", "ids"]).astype({"id": "int64"})

    at = ["part", "segment"]
    parts = [r[0] for r in places.select("part").distinct().limit(MOST_FILTERED + 1).collect()]
    if len(parts) <= MOST_FILTERED:  # few files: the scan leaves out the others
        payload = payload.where(F.col("part").isin(parts))
    files = payload.join(places.select(*at).distinct(), at, "left_semi")
    return files.groupBy(*at).cogroup(places.groupBy(*at)).applyInPandas(fetch, "id long, ids array<long>").withColumnRenamed("id", id_col)
