"""Removal of repeated passages by a sparse, range-partitioned suffix array.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere
else. Sorting every suffix of the corpus would multiply it, so suffixes start
only at anchors, chosen by content: of all ``gram``-byte strings within a window
of the shortest length asked for, the one of least hash (the leftmost of equals).
A longer window takes the anchor of its middle. Equal windows choose the same
anchor, so two equal windows are seen at a pair of anchors with equal grams, and
the bytes that repeated windows around an anchor cover are one interval: as far
left and right as a window with a copy elsewhere reaches. No repeat is lost by
the sparseness.

1. One scan counts the grams of anchors. Those that recur set bits in a bitmap of
   fixed size, which a second scan takes to leave out most anchors that can't
   have a partner; a bit set by another gram only lets an anchor through.
2. Each anchor left has the 128-bit digest of its context (all windows that can
   choose it). Anchors whose context recurs are done: all of it repeats. Of each
   other context of a gram that has several, one row goes on with its bytes: these
   are the suffixes, with what is left of them.
3. Sampled grams are the splitters that range-partition the suffixes by leading
   bytes. A bucket is sorted twice by multikey quicksort, by what follows the
   anchor and by what precedes it, backwards. Two windows are equal if their
   suffixes are in one run of the first order (common bytes up to the window's
   end) and one of the second (to its beginning): bytes decide, not hashes.
4. All suffixes of a gram go to one bucket, but for grams that fill MOST_BUCKETS
   or more of them (license lines and the like): those are compared across buckets
   by 128-bit digests. Windows are taken STRIDE neighbouring offsets at a time: only
   what all windows of such a block share (its core) can bring two suffixes
   together, and where all that they cover (its hull) recurs, all of them do. Windows
   themselves are listed for one suffix of each hull, and only where other hulls have its core.
5. Intervals are joined per distinct text. Equal texts are one text throughout,
   identified by two 64-bit hashes, and go whole if they have the length.

Defined results for odd input: null texts are empty; empty and short texts keep
everything; a repeated row is a copy of a document like any other; null ids
take part. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

LENGTH = 400
GRAM = 64
PASSAGE = 256  # bytes of the shortest repeated string that a passage is made of
PASSAGE_WORDS = 50
CHUNK_BYTES = 1 << 20
POSITION_BITS = 22
FILTER_BITS = 26
SAMPLE_ROWS = 100_000
BUCKET_ROWS = 8_192
MOST_BUCKETS = 2
STRIDE = 16
SALTS = 16
MULTIPLIER = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Shape:
    """The lengths of windows that are looked for, and of the grams that anchor them."""

    lengths: tuple[int, ...]
    gram: int

    @property
    def window(self) -> int:
        """Every run of so many bytes has an anchor."""
        return min(self.lengths)

    def offsets(self, length: int) -> range:
        """How many bytes before its anchor a window of this length can begin: the anchor is in the window's middle."""
        shift = (length - self.window) // 2
        return range(shift, shift + self.window - self.gram + 1)

    @property
    def blocks(self) -> list[tuple[int, int, int]]:
        """(length, first offset, last offset) of up to STRIDE neighbouring windows, by the number of the block."""
        return [(n, o, min(o + STRIDE - 1, self.offsets(n)[-1])) for n in self.lengths for o in self.offsets(n)[::STRIDE]]

    @property
    def left(self) -> int:
        """Bytes before an anchor that belong to its context."""
        return max(self.offsets(n)[-1] for n in self.lengths)

    @property
    def right(self) -> int:
        """Bytes from an anchor on that belong to its context."""
        return max(n - self.offsets(n)[0] for n in self.lengths)


class Rolling:
    """Position-independent hashes of grams, to choose anchors by: prefix sums of byte * m^i modulo 2^64, for up to ``size`` bytes."""

    def __init__(self, size: int):
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, m, np.uint64))]) for m in (MULTIPLIER, inverse))

    def grams(self, data: np.ndarray, gram: int) -> np.ndarray:
        """The hash of the gram that begins at each byte but the last few."""
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=prefix[1:])
        return mixed((prefix[gram:] - prefix[:-gram]) * self.down[: len(prefix) - gram])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    """Least of each ``window`` consecutive values: running minima within blocks, from both sides."""
    n = len(x)
    blocks = np.full(-(-n // window) * window, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - window + 1
    return np.minimum(behind[:last], ahead[window - 1 : window - 1 + last])


def pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (text number, offset, bytes): long texts in pieces that share ``window - 1`` bytes, so every window is in one."""
    chunk, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), CHUNK_BYTES):
            part = text[at : at + CHUNK_BYTES + window - 1]
            if len(part) < window:
                continue
            chunk.append((i, at, part))
            size += len(part)
            if size >= CHUNK_BYTES:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def anchors_of(parts: list[bytes], rolling: Rolling, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part number, offset, gram hash) of the anchors of all windows of each part."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    hashes = rolling.grams(np.frombuffer(b"".join(parts), np.uint8), shape.gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (sliding_min(packed, shape.window - shape.gram + 1) & low).astype(np.int64)
    starts = np.arange(len(chosen))
    part = np.repeat(np.arange(len(parts)), sizes)[: len(chosen)]
    chosen = chosen[starts + shape.window <= ends[part]]
    chosen = chosen[np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))] if len(chosen) else chosen
    owner = np.searchsorted(ends, chosen, "right")
    return owner, chosen - (ends - sizes)[owner], hashes[chosen]


def count_grams(shape: Shape, encode: Callable[[str], bytes]):
    """Texts to (gram, n)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = Rolling(2 * CHUNK_BYTES + 4 * shape.window)
        for pdf in batches:
            for chunk in pieces([encode(t) for t in pdf["text"]], shape.window):
                gram, n = np.unique(anchors_of([c[2] for c in chunk], rolling, shape)[2], return_counts=True)
                yield pd.DataFrame({"gram": gram.view(np.int64), "n": n.astype(np.int32)})

    return count


def find_anchors(shape: Shape, bitmap, encode: Callable[[str], bytes]):
    """(k1, k2) and text to (k1, k2, pos, gram, c1, c2) of each anchor whose gram the bitmap lets through."""

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling, recurring = Rolling(2 * CHUNK_BYTES + 4 * shape.window), np.frombuffer(bitmap.value, np.uint8)
        digest = xxhash.xxh3_128_digest
        for pdf in batches:
            texts = [encode(t) for t in pdf["text"]]
            k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
            for chunk in pieces(texts, shape.window):
                owner, offset, gram = anchors_of([c[2] for c in chunk], rolling, shape)
                bit = gram & np.uint64((1 << FILTER_BITS) - 1)
                let_through = (recurring[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                owner, gram = owner[let_through], gram[let_through]
                number, at = (np.array([c[j] for c in chunk])[owner] for j in (0, 1))
                pos = at + offset[let_through]
                found = []
                for i, p in zip(number.tolist(), pos.tolist(), strict=True):
                    begin = max(p - shape.left, 0)
                    # the bytes and how many of them come before the anchor
                    found.append(digest(texts[i][begin : p + shape.right], p - begin))
                context = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pd.DataFrame({"k1": k1[number], "k2": k2[number], "pos": pos.astype(np.int32), "gram": gram.view(np.int64), "c1": context[:, 0], "c2": context[:, 1]})

    return anchors


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix and, for each but the first, how many bytes it shares with the one before.

    Ternary splitting on the 8-byte word at a depth: smaller and larger rows go on
    at that depth, equal ones at the next.
    """
    keys = np.pad(keys, ((0, 0), (0, -keys.shape[1] % 8)))
    words = np.ascontiguousarray(keys).view(">u8").astype(np.uint64)
    order = np.arange(len(words))
    todo = [(0, len(order), 0)]
    while todo:
        begin, end, depth = todo.pop()
        if end - begin < 2 or depth == words.shape[1]:
            continue
        rows = order[begin:end]
        own = words[rows, depth]
        if end - begin <= 64:  # short ranges: sort by all that is left
            order[begin:end] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        pivot = np.sort(own[[0, len(own) // 2, -1]])[1]
        less, equal = own < pivot, own == pivot
        order[begin:end] = np.concatenate([rows[less], rows[equal], rows[~(less | equal)]])
        a, b = begin + int(less.sum()), begin + int(less.sum() + equal.sum())
        todo += [(begin, a, depth), (a, b, depth + 1), (b, end, depth)]
    ordered = keys[order]
    differs = ordered[1:] != ordered[:-1]
    return order, np.where(differs.any(axis=1), differs.argmax(axis=1), keys.shape[1])


def matrices(pdf: pd.DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What follows each anchor and what precedes it, backwards, zero-padded; and the lengths of both."""
    left = pdf["left"].to_numpy(np.int64)
    right = np.fromiter(map(len, pdf["bytes"]), np.int64, len(pdf)) - left
    after, before = np.zeros((len(pdf), shape.right), np.uint8), np.zeros((len(pdf), shape.left), np.uint8)
    for i, (data, n) in enumerate(zip(pdf["bytes"], left.tolist(), strict=True)):
        own = np.frombuffer(data, np.uint8)
        after[i, : len(own) - n] = own[n:]
        before[i, :n] = own[:n][::-1]
    return after, before, right, left


def runs(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """The run of rows with ``depth`` bytes in common that each row is in."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(shared < depth)])
    return out


def compare_bucket(shape: Shape):
    """For a bucket of suffixes: (k1, k2, length, begin, end) of what repeats around each anchor."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        after, before, right, left = matrices(pdf, shape)
        following, preceding = multikey_sort(after), multikey_sort(before)
        out = []
        for length in shape.lengths:
            most, least = np.full(len(pdf), -1), np.full(len(pdf), shape.left + 1)
            for offset in shape.offsets(length):
                at = np.flatnonzero((left >= offset) & (right >= length - offset))
                if len(at) < 2:
                    continue
                both = runs(*following, length - offset)[at] * len(pdf) + runs(*preceding, offset)[at]
                by = np.argsort(both, kind="stable")
                equal = both[by][1:] == both[by][:-1]
                found = at[by[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]]
                most[found] = offset
                least[found] = np.minimum(least[found], offset)
            own = pdf.loc[most >= 0, ["k1", "k2", "pos"]]
            pos = own["pos"].to_numpy()
            out.append(own[["k1", "k2"]].assign(length=length, begin=pos - most[most >= 0], end=pos - least[most >= 0] + length))
        return pd.concat(out)

    return compare


def explode_blocks(shape: Shape):
    """Suffixes to (k1, k2, pos, block, least, most, c1, c2, h1, h2) for every block in which they have windows: the offsets of the first and last, and the digests of core and hull."""
    digests = lambda found: np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for pdf in batches:
            left = pdf["left"].to_numpy(np.int64)
            right = np.fromiter(map(len, pdf["bytes"]), np.int64, len(pdf)) - left
            data = pdf["bytes"].tolist()
            for number, (length, first, last) in enumerate(shape.blocks):
                least, most = np.maximum(first, length - right), np.minimum(last, left)
                at = np.flatnonzero(least <= most)
                own = [(data[i], n) for i, n in zip(at.tolist(), left[at].tolist(), strict=True)]
                core = digests(digest(x[n - first : n + length - last]) for x, n in own)
                # the bytes and how many of them come before the anchor
                hull = digests(digest(x[max(n - last, 0) : n + length - first], min(n, last)) for x, n in own)
                yield pdf.iloc[at][["k1", "k2", "pos"]].assign(block=np.int32(number), least=least[at].astype(np.int32), most=most[at].astype(np.int32), c1=core[:, 0], c2=core[:, 1], h1=hull[:, 0], h2=hull[:, 1])

    return blocks


def explode_windows(shape: Shape):
    """Suffixes with a block to (k1, k2, pos, block, offset, w1, w2) for every window of the block."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for pdf in batches:
            rows, found = [], []
            for k1, k2, pos, left, data, number in zip(pdf["k1"], pdf["k2"], pdf["pos"], pdf["left"], pdf["bytes"], pdf["block"], strict=True):
                length, first, last = shape.blocks[number]
                for offset in range(max(first, length - len(data) + left), min(last, left) + 1):
                    rows.append((k1, k2, pos, number, offset))
                    found.append(digest(data[left - offset : left - offset + length]))
            own = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pd.DataFrame(rows, columns=["k1", "k2", "pos", "block", "offset"]).assign(w1=own[:, 0], w2=own[:, 1])

    return windows


def repeats_across(suffixes: DataFrame, shape: Shape) -> DataFrame:
    """(k1, k2, length, begin, end) of what repeats around each anchor, for suffixes in any number of buckets."""
    at, block = ["k1", "k2", "pos"], ["block", "c1", "c2"]
    rows = stored(suffixes.mapInPandas(explode_blocks(shape), "k1 long, k2 long, pos int, block int, least int, most int, c1 long, c2 long, h1 long, h2 long"), "blocks")
    hulls = stored(rows.groupBy(*block, "h1", "h2").agg(F.min(F.struct(*at)).alias("low"), F.max(F.struct(*at)).alias("high")), "hulls")
    whole = rows.join(hulls.where("low <> high").select("block", "h1", "h2"), ["block", "h1", "h2"]).select(*at, "block", "least", "most")
    open_cores = hulls.groupBy(*block).agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("a <> b").select(*block)
    asked = hulls.join(open_cores, block).select("low.*", "block")
    windows = stored(suffixes.join(asked, at).mapInPandas(explode_windows(shape), "k1 long, k2 long, pos int, block int, offset int, w1 long, w2 long"), "windows")
    window = ["block", "offset", "w1", "w2"]
    recurring = windows.groupBy(*window).agg(F.min(F.struct(*at)).alias("low"), F.max(F.struct(*at)).alias("high")).where("low <> high").select(*window)
    found = whole.unionByName(windows.join(recurring, window).select(*at, "block", F.col("offset").alias("least"), F.col("offset").alias("most")))
    length = F.get(F.array(*(F.lit(n) for n, _, _ in shape.blocks)), F.col("block"))
    found = found.groupBy(*at, length.alias("length")).agg(F.max("most").alias("most"), F.min("least").alias("least"))
    return found.select("k1", "k2", "length", (F.col("pos") - F.col("most")).alias("begin"), (F.col("pos") - F.col("least") + F.col("length")).alias("end"))


def cut_suffixes(shape: Shape, splitters: np.ndarray | None, encode: Callable[[str], bytes]):
    """Texts with positions to suffixes with their bytes, bucket (0 without splitters) and whether their gram spreads over several buckets."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k1, k2, text, anchors in zip(pdf["k1"], pdf["k2"], pdf["text"], pdf["anchors"], strict=True):
                data = encode(text)
                for p in anchors.tolist():
                    left = min(p, shape.left)
                    rows.append((k1, k2, p, left, data[p - left : p + shape.right]))
            out = pd.DataFrame(rows, columns=["k1", "k2", "pos", "left", "bytes"])
            lead = np.array([b[n : n + shape.gram] for b, n in zip(out["bytes"], out["left"], strict=True)], f"S{shape.gram}")
            if splitters is None:
                yield out.assign(bucket=np.int32(0), boundary=False)
            else:
                bucket = np.searchsorted(splitters, lead, "right")
                spread = bucket - np.searchsorted(splitters, lead, "left")
                yield out.assign(bucket=bucket.astype(np.int32), boundary=spread >= MOST_BUCKETS)

    return cut


SUFFIX = "k1 long, k2 long, pos int, left int, bytes binary, bucket int, boundary boolean"


def text_keys(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts (null: empty) with the two hashes that stand for them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"text": text, "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})


def gram_filter(spark: SparkSession, texts: DataFrame, shape: Shape, encode: Callable[[str], bytes]):
    """A broadcast bitmap of 2^FILTER_BITS bits, those of the grams that several anchors have set. The hashes' low bits
    number them: an anchor has the least hash of a window, so the high ones are nearly always zero."""
    counts = texts.select("text").mapInPandas(count_grams(shape, encode), "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n"))
    word = F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6)
    words = counts.where("n > 1").select(word.alias("word"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2^(FILTER_BITS - 6) rows
    bitmap = np.zeros(1 << (FILTER_BITS - 6), "<i8")
    bitmap[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(bitmap.tobytes())


def splitter_grams(held: DataFrame, shape: Shape, suffixes: int, encode: Callable[[str], bytes]) -> np.ndarray:
    """Grams that cut the suffixes into buckets of about BUCKET_ROWS, from a sample of at most about SAMPLE_ROWS; one that fills several stands as often."""
    share = min(1.0, SAMPLE_ROWS / max(1, suffixes))
    chosen = F.filter("anchors", lambda p: F.pmod(F.xxhash64("k1", p), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = held.select("k1", "k2", "text", chosen.alias("anchors")).where(F.size("anchors") > 0)
    found = rows.mapInPandas(cut_suffixes(shape, None, encode), SUFFIX).selectExpr(f"substring(bytes, left + 1, {shape.gram}) lead").toPandas()["lead"].tolist()
    sample = np.sort(np.array([bytes(x) for x in found], f"S{shape.gram}"))
    buckets = max(1, -(-suffixes // BUCKET_ROWS))
    return sample[np.linspace(0, len(sample) - 1, buckets + 1).astype(np.int64)[1:-1]] if len(sample) else sample


def repeated_passages(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", code: Callable[[str], bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, spans). copies: (k1, k2) of texts of the least length or more that several rows hold, with their words. spans:
    (k1, k2, text, spans) of other texts with repeated passages, spans as array of (length, begin, end), byte intervals
    that may overlap: covered by repeated windows of that length, or, for length 0, repeated as a whole.

    ``code``: what stands for a text instead of its UTF-8 bytes; then texts of any length count as copies, and
    a span of length 0 may end behind the code's end."""
    spark = docs.sparkSession
    shape = Shape(tuple(lengths), gram)
    texts = text_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    encode = code or str.encode
    if code is None:
        texts = texts.where(F.octet_length("text") >= shape.window)
    key, whose = ["k1", "k2"], ["gram", "c1", "c2"]
    groups = stored(texts.groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.max(F.regexp_count("text", F.lit(r"(?U)\S+"))).alias("words"), F.max(F.octet_length("text")).alias("size")), "texts")
    bitmap = gram_filter(spark, texts, shape, encode)
    anchors = stored(texts.select(*key, "text").mapInPandas(find_anchors(shape, bitmap, encode), "k1 long, k2 long, pos int, gram long, c1 long, c2 long"), "anchors")

    at = F.struct(*key, "pos")
    contexts = anchors.groupBy(*whose).agg(F.min(at).alias("low"), F.max(at).alias("high"))
    contexts = stored(contexts.select(*whose, "low", (F.col("low") != F.col("high")).alias("recurs")), "contexts")
    whole = stored(anchors.join(contexts.where("recurs").select(*whose), whose).groupBy(*key).agg(F.collect_set("pos").alias("whole")), "whole")

    # one row of every context of a gram that has several; a gram of very many contexts is dealt out
    several = contexts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    wanted = contexts.withColumn("salt", F.pmod("c1", F.lit(SALTS)).cast("int")).join(several, ["gram", "salt"]).select("low.*")
    by_text = stored(wanted.groupBy(*key).agg(F.collect_list("pos").alias("anchors")), "wanted")
    concerned = groups.join(by_text, key, "left").join(whole, key, "left").where("anchors IS NOT NULL OR whole IS NOT NULL")
    concerned = concerned.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "first", "anchors", "whole")
    mine = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("id").eqNullSafe(F.col("first"))
    # rows of one id and text come twice, but are copies, whose spans aren't asked for
    held = stored(texts.join(concerned, mine).select(*key, "text", "anchors", "whole"), "held")

    with_suffixes = held.where("anchors IS NOT NULL").select(*key, "text", "anchors")
    count = with_suffixes.agg(F.sum(F.size("anchors"))).first()[0] or 0
    splitters = splitter_grams(with_suffixes, shape, count, encode)
    suffixes = with_suffixes.mapInPandas(cut_suffixes(shape, splitters, encode), SUFFIX)
    span = "k1 long, k2 long, length int, begin int, end int"
    found = suffixes.where("NOT boundary").groupBy("bucket").applyInPandas(compare_bucket(shape), span)

    across = stored(suffixes.where("boundary").drop("bucket", "boundary"), "across")
    found = found.unionByName(repeats_across(across, shape))
    parts = found.groupBy(*key).agg(F.collect_list(F.struct("length", "begin", "end")).alias("spans"))

    context = lambda p: F.struct(F.lit(0).alias("length"), F.greatest(p - shape.left, F.lit(0)).alias("begin"), (F.least(p + shape.right, F.octet_length("text")) if code is None else p + shape.right).alias("end"))
    none = F.array().cast("array<struct<length:int,begin:int,end:int>>")
    spans = held.join(parts, key, "left").select(*key, "text", F.concat(F.coalesce(F.transform("whole", context), none), F.coalesce("spans", none)).alias("spans"))
    copies = groups.where("copies > 1").select(*key, "words", "size")
    return copies, spans.where(F.size("spans") > 0).join(copies, key, "left_anti")


def merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching intervals that repeated windows of ``length`` bytes cover."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans if s["length"] == length or (not s["length"] and s["end"] - s["begin"] >= length)):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def without(data: bytes, spans: list[dict], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that stay, and the runs that go."""
    gone = merged(spans, length)
    return b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in gone)], [*(r[0] for r in gone), len(data)], strict=True)), gone


def whole_words(data: bytes, begin: int, end: int) -> int:
    """Words of data[begin:end] that none of its edges cuts."""
    own = data[begin:end]
    cut = (begin > 0 and not data[begin - 1 : begin + 1].isspace() and data[begin - 1 : begin].strip() and own[:1].strip()) or b""
    tail = (end < len(data) and own[-1:].strip() and data[end : end + 1].strip()) or b""
    return len(own.split()) - bool(cut) - bool(tail)


def deduplicated(docs: DataFrame, length: int = LENGTH, passage: int | None = PASSAGE, passage_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passages) of every document.

    n_passages: the maximal runs of bytes covered by strings of ``passage`` bytes that also start anywhere else, and
    that hold more than ``passage_words`` words; nothing is removed for them.
    """
    passage = min(passage or length, length)
    copies, spans = repeated_passages(docs, tuple(sorted({length, passage}, reverse=True)), id_col=id_col, text_col=text_col, **options)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k1, k2, text, found in zip(pdf["k1"], pdf["k2"], pdf["text"], pdf["spans"], strict=True):
                data = text.encode()
                kept, gone = without(data, found, length)
                n = sum(whole_words(data, a, b) > passage_words for a, b in merged(found, passage))
                rows.append((k1, k2, sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(), n))
            yield pd.DataFrame(rows, columns=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "n_passages"]).astype({"kept_sha256": object})

    cut = spans.mapInPandas(digest, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, n_passages long")
    long_enough = F.col("size") >= length
    empty = copies.select(
        "k1", "k2", F.when(long_enough, F.col("size")).otherwise(0).cast("long").alias("n_removed"), long_enough.cast("long").alias("n_spans"),
        F.when(long_enough, F.sha2(F.lit("").cast("binary"), 256)).alias("kept_sha256"), (F.col("words") > passage_words).cast("long").alias("n_passages"),
    )
    own = text_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select(
        "id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    )
    out = own.join(cut.unionByName(empty), ["k1", "k2"], "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), "n_bytes", number("n_removed"), number("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), number("n_passages"))


def rewritten(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text; characters cut in half go as well."""
    copies, spans = repeated_passages(docs, (length,), id_col=id_col, text_col=text_col, **options)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [without(text.encode(), found, length)[0].decode("utf-8", "ignore") for text, found in zip(pdf["text"], pdf["spans"], strict=True)]
            yield pdf[["k1", "k2"]].assign(kept=pd.Series(kept, index=pdf.index, dtype=object))

    cut = spans.select("k1", "k2", "text", "spans").mapInPandas(keep, "k1 long, k2 long, kept string")
    cut = cut.unionByName(copies.select("k1", "k2", F.lit("").alias("kept"))).withColumnsRenamed({"k1": "__k1", "k2": "__k2", "kept": "__kept"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)})
    out = keyed.join(cut, (F.col("__t1") == F.col("__k1")) & (F.col("__t2") == F.col("__k2")), "left")
    return out.withColumn(text_col, F.coalesce("__kept", text_col)).select(*docs.columns)


__all__ = ["deduplicated", "repeated_passages", "rewritten"]
