"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

Features are runs of words; a feature's bucket is a hash of it. The steps:

1. ``postings``: each task turns batches of texts into inverted postings, packed by
   part (a range of buckets): for each bucket the batch's documents and counts.
   They are shuffled by part and slice (a hash of the batch, so that no part is one
   task's work however large the corpus) and stored, sorted by bucket range.
2. ``gains``: the counts of each bucket in both corpora meet by bucket, where its
   gain is computed; only sums per bucket and task are shuffled.
3. ``weights``: the postings of a part meet that part's gains; a task emits each
   batch's contributions to its documents, which are added up by batch.
4. ``ranked``: a seeded Gumbel draw without replacement; ranks come from a range sort
   and the sizes of its partitions, never from one sorted task.

Defined results for odd input: a null or empty text has no feature and weight 0; a
null id is drawn with the text ``null`` in its place and ties as the smallest; repeated
rows are documents of their own; an empty target gives every bucket the gain of the
smoothing alone; an empty table returns no rows. Columns other than the id and
the text are not read. Very long texts are read in pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

BUCKETS = 10_000
PARTS = 8
#: Postings of a batch are packed together; documents are numbered in 16 bits within it.
BATCH_DOCUMENTS, BATCH_BYTES = 8192, 8 << 20
#: Text is split into words so many bytes at a time.
PIECE_BYTES = 1 << 20
#: Distinct words a task remembers.
MOST_WORDS = 200_000
POSTINGS = "part int, batch long, n int, payload binary"

#: Bytes of words: digits, letters (A-Z lower-cased) and whatever isn't ASCII. All others become blanks.
_WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_LONGEST = 32


def _zero_steps() -> np.ndarray:
    """[length][byte of the crc][its value]: what a crc becomes when so many bytes follow it, before those bytes' own crc is added. It is linear in the bits of the crc."""
    byte = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
    shift = np.zeros((_LONGEST + 1, 4, 256), np.uint32)
    for j in range(4):
        shift[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for length in range(1, _LONGEST + 1):
        before = shift[length - 1]
        shift[length] = (before >> np.uint32(8)) ^ byte[before & np.uint32(255)]
    return shift


class Words(dict):
    """Numbers of words, with what their features' hashes need: the crc of the word, of the word and a blank, and the length."""

    def __init__(self):
        super().__init__()
        self.own, self.open, self.length, self.words = [], [], [], []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.own.append(zlib.crc32(word))
        self.open.append(zlib.crc32(word + b" "))
        self.length.append(len(word))
        self.words.append(word)
        return at


def buckets_of(words: Words, ids: np.ndarray, first: np.ndarray, shift: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and word pairs of a run of texts, and the position of the word each ends with. first: whether a word begins a text."""
    own, opened, length = (np.array(x, t) for x, t in ((words.own, np.uint32), (words.open, np.uint32), (words.length, np.int64)))
    second = np.flatnonzero(~first)
    a, b = ids[second - 1], ids[second]
    crc, size = opened[a], length[b]
    pair = np.zeros(len(a), np.uint32)
    short = size <= _LONGEST
    s, c = size[short], crc[short]
    pair[short] = shift[s, 0, c & 255] ^ shift[s, 1, (c >> 8) & 255] ^ shift[s, 2, (c >> 16) & 255] ^ shift[s, 3, c >> 24] ^ own[b[short]]
    for i in np.flatnonzero(~short):
        pair[i] = zlib.crc32(words.words[b[i]], int(crc[i]))
    return np.concatenate([own[ids], pair]) % np.uint32(buckets), np.concatenate([np.arange(len(ids)), second])


def pieces_of(text: bytes) -> Iterator[bytes]:
    """The text with blanks for all but words, in pieces that end between words."""
    text = text.translate(_WORD_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def counted(texts: list[str | None], words: Words, shift: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, words a text): keys are bucket * number of texts + text, ascending."""
    n, keys, counts = len(texts), [], []
    sizes, ids, marks = np.zeros(n, np.int64), [], []

    def settle() -> None:
        if ids:
            flat, at = np.concatenate(ids), np.concatenate([np.full(len(x), t) for x, (t, _) in zip(ids, marks, strict=True)])
            first = np.zeros(len(flat), bool)
            first[np.cumsum([0, *(len(x) for x in ids)])[:-1]] = [bool(new) for _, new in marks]
            first[0] = True
            found, where = buckets_of(words, flat, first, shift, buckets)
            if marks[0][1] is None:  # a word carried over: its own bucket was counted before
                found, where = found[1:], where[1:]
            own, number = np.unique(found.astype(np.int64) * n + at[where], return_counts=True)
            keys.append(own)
            counts.append(number)
        ids.clear(), marks.clear()

    pending = 0
    for t, text in enumerate(texts):
        last = None
        for piece in pieces_of(text.encode()) if text else ():
            own = list(map(words.__getitem__, piece.split()))
            if not own:
                continue
            if pending > BATCH_BYTES or len(words) > MOST_WORDS:
                settle()
                pending = 0
                carried = words.words[last] if last is not None else None
                if len(words) > MOST_WORDS:
                    remembered = [words.words[i] for i in own]
                    words.clear(), words.__init__()
                    own = [words[w] for w in remembered]
                if carried is not None:
                    ids.append(np.array([words[carried]]))
                    marks.append((t, None))
                    # from here on the pair of the carried word and the next is counted, not the carried word itself
            ids.append(np.array(own))
            marks.append((t, last is None))
            sizes[t] += len(own)
            pending += len(piece)
            last = own[-1]
    settle()
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes
    own, back = np.unique(np.concatenate(keys), return_inverse=True)
    return own, np.bincount(back, np.concatenate(counts)).astype(np.int64), sizes


def packed(keys: np.ndarray, counts: np.ndarray, n: int) -> bytes:
    """Postings as compressed bytes: document steps within a bucket (16 bits), counts (8 bits, larger ones apart), postings a bucket."""
    bucket, doc = keys // n, keys % n
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    steps = np.diff(doc, prepend=0)
    steps[start] = doc[start]
    large = np.flatnonzero(counts > 255)
    head = np.array([len(keys), len(start), len(large)], "<i4").tobytes()
    body = [bucket[start].astype("<i4"), np.diff(start, append=len(keys)).astype("<i4"), large.astype("<i4"), counts[large].astype("<i8"), (steps & 255).astype("u1"), (steps >> 8).astype("u1"), np.minimum(counts, 255).astype("u1")]
    return zlib.compress(head + b"".join(x.tobytes() for x in body), 1)


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, count) of each posting."""
    data = zlib.decompress(payload)
    size, starts, larges = np.frombuffer(data, "<i4", 3).tolist()
    at = 12

    def take(kind: str, number: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, number, at)
        at += out.nbytes
        return out

    bucket, runs, large, larger = take("<i4", starts), take("<i4", starts), take("<i4", larges), take("<i8", larges)
    steps = take("u1", size).astype(np.int64) + (take("u1", size).astype(np.int64) << 8)
    counts = take("u1", size).astype(np.int64)
    counts[large] = larger
    total = np.cumsum(steps)
    start = np.cumsum(runs) - runs
    return np.repeat(bucket, runs), total - np.repeat(total[start] - steps[start], runs), counts


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bounded numbers of documents and bytes."""
    for pdf in frames:
        size = pdf["text"].map(lambda x: len(x) if x else 0).to_numpy().cumsum()
        cut = np.arange(len(pdf)) // BATCH_DOCUMENTS * (1 << 40) + (size // BATCH_BYTES if len(size) else 0)
        for _, own in pdf.groupby(cut, sort=True):
            yield own


def _packer(buckets: int, parts: int):
    width = -(-buckets // parts)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, shift = Words(), _zero_steps()
        for number, pdf in enumerate(_batches(frames)):
            n, batch = len(pdf), (TaskContext.get().partitionId() << 32) + number
            keys, counts, sizes = counted(pdf["text"].tolist(), words, shift, buckets)
            rows = [{"part": -1, "batch": batch, "n": n, "payload": zlib.compress(sizes.astype("<i8").tobytes(), 1), "ids": pdf["id"].tolist()}]
            cuts = np.searchsorted(keys, np.arange(parts + 1) * width * n)
            for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    rows.append({"part": part, "batch": batch, "n": n, "payload": packed(keys[a:b], counts[a:b], n), "ids": None})
            yield pd.DataFrame(rows)

    return pack


def postings(docs: DataFrame, buckets: int = BUCKETS, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings of all texts, by part and slice: (part, batch, n, payload, ids); part -1 has the ids and numbers of words of a batch's documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(_packer(buckets, parts), f"{POSTINGS}, ids array<{kind}>")
    return stored(rows.repartition(shuffle_partitions(docs.sparkSession), "part", "batch").sortWithinPartitions("part", "batch"), "postings")


def _bucket_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for pdf in frames:
        for payload in pdf["payload"]:
            bucket, _, counts = unpacked(payload)
            own = np.bincount(bucket, counts).astype(np.int64)
            total = np.pad(total, (0, max(0, len(own) - len(total))))
            total[: len(own)] += own
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})


def bucket_counts(posted: DataFrame) -> DataFrame:
    """(bucket, n): features in each bucket."""
    return posted.where("part >= 0").select("payload").mapInPandas(_bucket_sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): floor of 1000 times the log ratio of the smoothed shares in the target and the raw corpus, for buckets that occur in either. raw, target: (bucket, n)."""
    met = raw.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    met = met.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    met = stored(met, "buckets")
    total = met.agg(F.sum("s"), F.sum("t")).first()
    of_raw, of_target = ((x or 0) + buckets for x in total)
    ratio = ((F.col("t") + 1).cast("double") * float(of_raw)) / ((F.col("s") + 1).cast("double") * float(of_target))
    return met.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def _contributions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for payload, n, at, gain in zip(pdf["payload"], pdf["n"], pdf["buckets"], pdf["gains"], strict=True):
            bucket, doc, counts = unpacked(payload)
            value = np.asarray(gain, np.int64)[np.searchsorted(np.asarray(at), bucket)]
            out.append(np.bincount(doc, value * counts, minlength=n).astype("<i8").tobytes())
        yield pd.DataFrame({"batch": pdf["batch"], "sums": out})


def _settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for row in pdf.to_dict("records"):
            sums = np.zeros(row["n"], np.int64)
            for part in row["parts"] if row["parts"] is not None else ():
                sums += np.frombuffer(part, "<i8")
            words = np.frombuffer(zlib.decompress(row["payload"]), "<i8")
            features = words + np.maximum(words - 1, 0)
            yield pd.DataFrame({"id": list(row["ids"]), "n_words": words, "n_features": features, "weight": sums // np.maximum(features, 1)})


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every document: the floored mean of the gains of its features."""
    width = -(-buckets // parts)
    posted = postings(docs, buckets, parts, id_col, text_col)
    asked = postings(target.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text")), buckets, parts, "id", "text")
    gain = gains(bucket_counts(posted), bucket_counts(asked), buckets).select(F.expr(f"bucket div {width}").cast("int").alias("part"), F.struct("bucket", "gain").alias("own"))
    by_part = gain.groupBy("part").agg(F.sort_array(F.collect_list("own")).alias("own")).select("part", F.col("own.bucket").alias("buckets"), F.col("own.gain").alias("gains"))
    # a part's gains meet its postings slice by slice; there are no more than `buckets` of them
    slices = max(1, -(-shuffle_partitions(docs.sparkSession) // parts))
    salted = posted.where("part >= 0").select("part", "batch", "n", "payload", F.pmod(F.xxhash64("batch"), F.lit(slices)).alias("slice"))
    met = salted.join(by_part.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))), ["part", "slice"])
    added = met.select("batch", "n", "payload", "buckets", "gains").mapInPandas(_contributions, "batch long, sums binary")
    heads = posted.where("part = -1").select("batch", "n", "payload", "ids")
    kind = docs.schema[id_col].dataType.simpleString()
    whole = heads.join(added.groupBy("batch").agg(F.collect_list("sums").alias("parts")), "batch", "left")  # one row a part at most
    return whole.mapInPandas(_settled, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def ranked(scored: DataFrame, eligible, percent: int, id_col: str) -> DataFrame:
    """``scored`` with rank: 1, 2, ... for the floor(percent * eligible / 100) highest scores, ties to the smaller id; null for the others."""
    spark = scored.sparkSession
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col(id_col).asc_nulls_first()]
    rows = scored.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    line = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    line = stored(line.withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)}), "line")
    sizes = line.groupBy("range").agg(F.count("*").alias("n"), F.sum(F.col("eligible").cast("long")).alias("of"))  # a row a partition
    bases = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"), F.sum("of").over(Window.partitionBy()).alias("of"))
    rank = F.col("base") + F.col("place") + 1
    drawn = line.join(F.broadcast(bases), "range").withColumn("rank", F.when(F.col("eligible") & (rank <= F.expr(f"of * {percent} div 100")), rank))
    return drawn.drop("eligible", "range", "place", "base", "of")


def drawn(docs: DataFrame, target: DataFrame, seed: int, percent: int, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document: a seeded Gumbel draw by weight among those of ``least_words`` words or more."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = weights(docs, target, id_col=id_col, text_col=text_col).withColumn("score", F.col("weight") + noise)
    return ranked(scored, F.col("n_words") >= least_words, percent, id_col).select(id_col, "n_features", "weight", "score", "rank")
