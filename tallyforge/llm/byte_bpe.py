"""Byte-level BPE in Spark expressions.

A text is split by the pattern; the distinct words of a run of texts are encoded
once, by higher-order functions: a word's bytes become ids of single bytes, and
a fold merges, step by step, the leftmost adjacent pair of least rank. The rank
map is literal: pairs of ids whose joined bytes are in the vocabulary. Spark looks
maps up by linear scan, so the literal is laid out as a hash table in arrays
(a displacement for each bucket makes every lookup two array accesses and one
comparison). Decoding concatenates the binary pieces of the ids.

All of it is narrow: a task's texts go through splitting, encoding and digest
in runs of bounded size, nothing is shuffled, and nothing depends on how many
different words the corpus has. A task remembers the words it has met, up to
REMEMBERED of them, and doesn't encode them again. The COMMON commonest words of
a sample of SAMPLE_ROWS texts are encoded beforehand, once for all tasks; which
words those are only decides what is encoded twice, never a result.

Defined results for odd input: null texts are empty and have no ids; repeated
rows are encoded each time; ids of any type, null or not, pass through. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, hash_sample, let
from .vocabularies import LETTERS

RUN_CHARS = 500_000
REMEMBERED = 200_000
COMMON = 196_608
SAMPLE_ROWS = 32_768
TEXTS_AT_ONCE = 256
WORDS_A_ROW = 2_048
EDGE = 0xFFFF
NONE = 0x1_0000
BUCKET_PAIRS = 4


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the joined bytes, for every way to cut a token into two tokens."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


class RankTable:
    """The pairs as arrays: a displacement for each bucket; a pair and its rank in each slot.

    Ids have 16 bits, so a pair has 32, its products with the factors stay below
    2^63, and a slot holds pair << 16 | rank.
    """

    FACTOR, SECOND = 0x5851F42D, 0x4C957F2D

    def __init__(self, pairs: dict[tuple[int, int], int]):
        if any(max(a, b, rank) >= EDGE for (a, b), rank in pairs.items()):
            raise ValueError(f"ids have to be below {EDGE}")
        pair = np.array([a << 16 | b for a, b in pairs], np.int64)
        rank = np.array(list(pairs.values()), np.int64)
        self.slots = 1 << max(4, int(len(pairs) * 1.3).bit_length())
        self.buckets = 1 << max(0, (len(pairs) // BUCKET_PAIRS).bit_length())
        self.shift = np.zeros(self.buckets, np.int64)
        self.entry = np.full(self.slots, (EDGE << 16 | EDGE) << 16, np.int64)
        home = self.bucket(pair)
        order = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[order], np.arange(self.buckets + 1))
        free = np.ones(self.slots, bool)
        for bucket in np.argsort(-np.diff(bounds), kind="stable").tolist():
            own = order[bounds[bucket] : bounds[bucket + 1]]
            if not len(own):
                break
            for shift in range(1 << 20):
                at = self.slot(pair[own], shift)
                if free[at].all() and len(np.unique(at)) == len(own):
                    break
            else:
                raise ValueError("no displacement fits")
            free[at] = False
            self.shift[bucket], self.entry[at] = shift, pair[own] << 16 | rank[own]

    def bucket(self, pair):
        return pair * self.FACTOR >> 24 & (self.buckets - 1)

    def slot(self, pair, shift):
        return (pair ^ shift) * self.SECOND >> 21 & (self.slots - 1)

    def column(self, own: Column, shift: Column, entry: Column) -> Column:
        """The rank of a pair of ids (a long, the left one in the high bits), or NONE. A slot that holds another pair leaves high bits when xored with this one."""
        mask = lambda n: F.lit(n - 1).cast("long")
        bucket = F.shiftright(own * F.lit(self.FACTOR).cast("long"), 24).bitwiseAND(mask(self.buckets))
        at = F.shiftright(own.bitwiseXOR(F.get(shift, bucket)) * F.lit(self.SECOND).cast("long"), 21).bitwiseAND(mask(self.slots))
        return F.least(F.get(entry, at).bitwiseXOR(F.shiftleft(own, 16)), F.lit(NONE).cast("long"))


def literal_array(values, kind: str) -> Column:
    """A constant array: a split string literal, which the optimizer folds into one value."""
    text = F.split(F.lit(",".join(map(str, values))), ",")
    return text if kind == "string" else text.cast(f"array<{kind}>")


def merged_ids(words: Column, ranks: dict[bytes, int], table: RankTable) -> Column:
    """The ids of each of an array of words. The tables are bound once around all words, so a plan holds each of them once."""
    ids = [ranks[bytes([b])] for b in range(256)]
    single = literal_array([NONE << 16 | i for i in ids], "long")
    double = literal_array([ranks.get(bytes([a, b]), NONE) << 16 | ids[a] for a in range(256) for b in range(256)], "long")
    shift, entry = literal_array(table.shift.tolist(), "long"), literal_array(table.entry.tolist(), "long")
    return let(single, lambda x: let(double, lambda d: let(shift, lambda y: let(entry, lambda z: F.transform(words, lambda w: word_ids(w, table, x, d, y, z))))))


def word_ids(word: Column, table: RankTable, single: Column, double: Column, shift: Column, entry: Column) -> Column:
    """The ids of a word (array of its bytes as long): array of long.

    The state of the fold is one array: for each id, the rank of the pair that it
    begins, then the id itself in the low 16 bits; an id that is in no pair stands
    at either edge. The least element is the next merge (equal ranks at once are
    the same joined bytes). A step replaces the pair by the id that has its rank,
    and looks up the two pairs that are new. single and double hold the elements
    of a last byte and of a byte before another.
    """
    low, edge = F.lit(0xFFFF).cast("long"), F.lit(EDGE).cast("long")
    element = lambda own: F.shiftleft(table.column(own, shift, entry), 16).bitwiseOR(F.shiftright(own, 16))
    idle = F.lit(NONE << 16).cast("long")

    def merge(state: Column, least: Column) -> Column:
        def at_place(at: Column) -> Column:
            new = F.shiftright(least, 16)
            before, after = (F.get(state, at + i).bitwiseAND(low) for i in (-2, 1))
            pairs = F.array(F.shiftleft(before, 16).bitwiseOR(new), F.shiftleft(new, 16).bitwiseOR(after))
            return F.concat(F.slice(state, F.lit(1), at - 2), F.transform(pairs, element), F.slice(state, at + 2, F.size(state)))

        return let(F.array_position(state, least).cast("int"), at_place)

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state), lambda least: F.when(least < idle, merge(state, least)).otherwise(state))

    ends = F.array(idle.bitwiseOR(edge))
    start = F.zip_with(word, F.slice(word, F.lit(2), F.size(word)), lambda a, b: F.coalesce(F.get(double, F.shiftleft(a, 8) + b), F.get(single, a)))
    merged = F.aggregate(F.slice(word, F.lit(2), F.size(word)), F.concat(ends, start, ends), step)
    ids = let(merged, lambda m: F.transform(F.slice(m, F.lit(2), F.size(m) - 2), lambda x: x.bitwiseAND(low)))
    return F.when(F.size(word) > 0, ids).otherwise(F.array().cast("array<long>"))


def decoded(encoded: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of each of an array of arrays of ids: their binary pieces, concatenated."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    table = literal_array([p.hex() for p in pieces], "string")
    return let(table, lambda t: F.transform(encoded, lambda ids: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))))


#: Texts for which the quick pattern finds what the rank file's own one does.
PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
QUICK = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")


def splitter(pattern: str, quick: bool = True):
    """A function from a text to its words; ``quick``: texts that PLAIN matches go through QUICK."""
    #: White space as the rank files' own library has it, without the four separators that Python adds.
    split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    return lambda text: (QUICK if quick and PLAIN.fullmatch(text) else split).findall(text)


class Numbers(dict):
    """Numbers by word; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def count_words(pattern: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = splitter(pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                found = Counter(w for t in texts[at : at + 512] for w in words_of(t or ""))
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return count


def word_bytes(words: list[str]) -> pa.ListArray:
    """The bytes of each word, as longs."""
    data = [w.encode() for w in words]
    ends = np.cumsum([0, *map(len, data)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(data), np.uint8).astype(np.int64))


def runs_of_words(pattern: str, common):
    """Texts to runs: ids of the documents, the word numbers of each, the task's new words as bytes, and whether the numbers begin again."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, often = splitter(pattern), common.value
        begun = lambda: Numbers(zip(often.to_pylist(), range(len(often)), strict=True))
        whole = lambda x: pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x)
        known, restart = begun(), True
        for batch in batches:
            numbers, size, first, begin = [], 0, len(known), 0
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                for i, text in enumerate(batch.column("text").slice(at, TEXTS_AT_ONCE).to_pylist(), at):
                    numbers.append(np.array(list(map(known.__getitem__, words_of(text or ""))), "<u4").tobytes())
                    size += len(text or "")
                    if size >= RUN_CHARS or i == batch.num_rows - 1:
                        words = word_bytes(list(islice(known, first, None)))
                        columns = [whole(batch.column("id").slice(begin, len(numbers))), whole(pa.array(numbers, pa.binary())), whole(words), pa.array([restart])]
                        yield pa.RecordBatch.from_arrays(columns, ["ids", "numbers", "words", "restart"])
                        numbers, size, begin, restart = [], 0, i + 1, False
                        if len(known) > len(often) + REMEMBERED:
                            del known
                            known, restart = begun(), True
                        first = len(known)

    return runs


class Pieces:
    """Sequences of numbers by place, in one array: a word takes about ten bytes beside its own."""

    def __init__(self, ends: np.ndarray, data: np.ndarray):
        """ends: where each sequence ends, after a leading zero."""
        self.ends, self.data = ends, data

    @classmethod
    def of(cls, values: pa.Array, kind: str) -> Pieces:
        """From an array of lists or binaries."""
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
        if not len(values):
            return cls(ends, np.zeros(0, kind))
        data = values.values.to_numpy() if pa.types.is_list(values.type) else np.frombuffer(values.buffers()[2], np.uint8)
        return cls(ends - ends[0], data[ends[0] : ends[-1]].astype(kind))

    def with_more(self, other: Pieces) -> Pieces:
        return Pieces(np.concatenate([self.ends, other.ends[1:] + self.ends[-1]]), np.concatenate([self.data, other.data]))

    def joined(self, at: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences at ``at`` one after another, and where each part of ``at`` that ends at one of the ``cuts`` ends."""
        begin = self.ends[at].astype(np.int64)
        n = self.ends[at + 1] - begin
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        return self.data[np.repeat(begin - total[:-1], n) + np.arange(total[-1])], total[cuts]


def digests(common):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, n_tokens, ids_sha256, decoded_sha256) of each document, from its words' ids and bytes."""
        ids, pieces = often = common.value
        for batch in batches:
            docs, numbers, encoded, data, restart = (batch.column(c) for c in ("ids", "numbers", "encoded", "decoded", "restart"))
            for i in range(batch.num_rows):
                if restart[i].as_py():
                    ids, pieces = often
                ids, pieces = ids.with_more(Pieces.of(encoded[i].values, "<u2")), pieces.with_more(Pieces.of(data[i].values, "u1"))
                own = Pieces.of(numbers[i].values, "u1")
                at, cuts = own.data.view("<u4"), own.ends // 4
                (codes, code_ends), (text, text_ends) = ids.joined(at, cuts), pieces.joined(at, cuts)
                hashed = lambda values, ends: [hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [docs[i].values, pa.array(np.diff(code_ends)), pa.array(hashed(codes.astype("<u4"), code_ends), pa.string()), pa.array(hashed(text, text_ends), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def coded(words: DataFrame, ranks: dict[bytes, int], table: RankTable) -> DataFrame:
    """``words`` with encoded, the ids of each of its array of words, and decoded, the bytes of those."""
    kept = [c for c in words.columns if c != "words"]
    both = words.select(*kept, merged_ids(F.col("words"), ranks, table).alias("encoded"))
    return both.select("*", decoded(F.col("encoded"), ranks).alias("decoded"))


def rows_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to rows of WORDS_A_ROW of them, as they are and as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, WORDS_A_ROW):
            own = batch.column("word").slice(at, WORDS_A_ROW)
            columns = [pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x) for x in (own, word_bytes(own.to_pylist()))]
            yield pa.RecordBatch.from_arrays(columns, ["own", "words"])


def common_words(rows: DataFrame, ranks: dict[bytes, int], table: RankTable, pattern: str) -> tuple[pa.Array, tuple[Pieces, Pieces]]:
    """At most COMMON words; their ids and bytes."""
    counts = hash_sample(rows, ["id"], SAMPLE_ROWS).select("text").mapInArrow(count_words(pattern), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(COMMON).select("word").repartition(-(-COMMON // WORDS_A_ROW) // 4, "word")
    found = coded(often.mapInArrow(rows_of_words, "own array<string>, words array<array<long>>"), ranks, table).toArrow()
    words, ids, pieces = (found.column(c).combine_chunks() for c in ("own", "encoded", "decoded"))
    return words.flatten().cast(pa.string()), (Pieces.of(ids.flatten(), "<u2"), Pieces.of(pieces.flatten(), "u1"))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    table = RankTable(pair_ranks(ranks))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    words, codes = common_words(rows, ranks, table, pattern)
    runs = rows.mapInArrow(runs_of_words(pattern, Shared(docs.sparkSession, words)), f"ids array<{kind}>, numbers array<binary>, words array<array<long>>, restart boolean")
    found = coded(runs, ranks, table).mapInArrow(digests(Shared(docs.sparkSession, codes)), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
