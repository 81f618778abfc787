"""Phrase collocations: depth-limited count tries per shard, merged in sorted order.

1. ``pair_filter``: a table of counters of hashed words and word pairs, summed over
   all tasks by slices of the table. A counter is never below the count of what
   falls on it, so a phrase with a word or pair whose counter stays below the least
   count can't be frequent. The table grows with the corpus up to 2**MOST_BITS
   counters; past that it only lets more through, so results never depend on it.
   Tasks are sent one bit a counter, at most 2**MOST_BITS / 8 bytes.
2. ``tries``: each task counts shards of about SHARD_WORDS words in a trie of
   depth DEPTH below the language, level by level: a node is its parent and a word.
   Paths end where the filter says they can't be frequent. The nodes are serialised
   sorted by their paths, in compressed blocks, one a prefix range. The ranges lie
   between paths drawn from a sample of the texts, which only balances them: any path
   has its range, and each node is in one. There are RANGES_A_PARTITION a shuffle
   partition, so more partitions mean smaller ranges, and MOST_RANGES at most.
3. ``frequent``: the sorted blocks of a range meet in a task and are merged;
   equal nodes are added up, and a walk over the merged trie gives each node the
   counts on its path, which are the left parts. Ancestors before the range's start are
   left to the next step.
4. ``scored``: suffix links: each phrase meets the counts of its right parts (and of
   missing left parts) by key. Then the lowest cut is scored, in exact decimals.
5. ``ranked``: phrases absorbed by a longer one go, and each language's first ones stay.
   A longer phrase that absorbs is witnessed by one that is a single word longer, as counts
   only fall when a phrase grows.

Defined results for odd input: a null text is empty, a null language is ``und`` (and
meets a language of that name), repeated rows count each time, ids aren't read and
may repeat, an empty table gives no rows; texts of any length are read in pieces
with the last words carried over. Only the named columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, hash_sample, shuffle_partitions, stored

DEPTH = 5
SHARD_WORDS = 1 << 21
PIECE_BYTES = 1 << 20
LEAST_BITS, MOST_BITS, SLICE_BITS = 18, 29, 18
#: Bytes a word, at least about, from which the number of counters follows.
WORD_BYTES = 6
RANGES_A_PARTITION, MOST_RANGES, SAMPLE_TEXTS_A_RANGE, SAMPLE_A_RANGE = 4, 1 << 15, 64, 32
NODES = "lang string, words array<string>, f long"

_BREAK = b"\xff"
#: A-Z lower-cased, piece ends as a byte that UTF-8 never has, tabs as blanks.
_BYTES = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


class _Numbers(dict):
    def __missing__(self, key) -> int:
        at = self[key] = len(self)
        return at


class Shard:
    """Words as numbers (0 ends a piece), in runs of a language each; the first ``starts`` words begin phrases here."""

    def __init__(self):
        self.numbers, self.langs, self.runs, self.codes, self.size = _Numbers({_BREAK: 0}), _Numbers(), [], [], 0

    def add(self, lang: str, tokens: list[bytes]) -> None:
        self.runs.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.codes.append(np.full(len(tokens), self.langs[lang], np.int64))
        self.size += len(tokens)

    def close(self, kept: int = 0) -> Shard:
        self.ids = np.concatenate([*self.runs, np.zeros(DEPTH, np.int64)])
        self.lang = np.concatenate([*self.codes, np.zeros(DEPTH, np.int64)])
        self.starts = self.size - kept
        self.words, self.names = list(self.numbers), list(self.langs)
        return self


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    text = text.translate(_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(_BREAK, b" \xff ").split()
        at = end


def shards(frames: Iterator[pd.DataFrame], size: int) -> Iterator[Shard]:
    """The texts of a task. A shard that ends inside a text hands its last words to the next."""
    shard = Shard()
    for pdf in frames:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            tail: list[bytes] = []
            for own in _tokens(text.encode()) if text else ():
                for at in range(0, len(own), size):
                    if shard.size >= size:
                        yield shard.close(len(tail))
                        shard = Shard()
                        if tail:
                            shard.add(lang, tail)
                    some = own[at : at + size]
                    shard.add(lang, some)
                    tail = (tail + some[-DEPTH + 1 :])[-DEPTH + 1 :]
            shard.add(lang, [_BREAK])
    if shard.size:
        yield shard.close()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in names), "<u8")


def slots(shard: Shard, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words and the pairs that start at each place, and whether there is a word and a pair."""
    own = _hashes(shard.words)[shard.ids] ^ _mixed(_hashes([x.encode() for x in shard.names]))[shard.lang]
    word = _mixed(own)
    pair = _mixed(word[:-1] + own[1:] * np.uint64(0xD6E8FEB86659FD93))
    here = shard.ids > 0
    cut = np.uint64(64 - bits)
    return (word >> cut).astype(np.int64), (pair >> cut).astype(np.int64), here, here[:-1] & here[1:]


def _slot_counts(bits: int, size: int):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in shards(frames, size):
            word, pair, here, both = slots(shard, bits)
            n = shard.starts
            slot, number = np.unique(np.concatenate([word[:n][here[:n]], pair[:n][both[:n]]]), return_counts=True)
            cut = np.searchsorted(slot, np.arange((1 << bits >> SLICE_BITS) + 1) << SLICE_BITS)
            rows = []
            for i in np.flatnonzero(np.diff(cut)):
                own, seen = slot[cut[i] : cut[i + 1]], number[cut[i] : cut[i + 1]]
                rows.append((i, zlib.compress(np.diff(own, prepend=i << SLICE_BITS).astype("<u4").tobytes() + seen.astype("<u4").tobytes(), 1)))
            if rows:
                yield pd.DataFrame(rows, columns=["slice", "counts"])

    return count


def _slice_bits(least: int):
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in frames:
            for i, data in zip(pdf["slice"], pdf["counts"], strict=True):
                steps, seen = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
                if i not in total:
                    total[i] = np.zeros(1 << SLICE_BITS, np.uint32)
                at = np.cumsum(steps, dtype=np.int64)
                total[i][at] = np.minimum(total[i][at].astype(np.int64) + seen, least)
        yield pd.DataFrame({"slice": list(total), "bits": [np.packbits(x >= least, bitorder="little").tobytes() for x in total.values()]})

    return add


def pair_filter(texts: DataFrame, least: int, shard_words: int = SHARD_WORDS) -> tuple[int, np.ndarray]:
    """(bits, bitmap): which of the 2**bits counters of words and pairs reach ``least``. texts: (lang, text)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(32 * size / WORD_BYTES / least).bit_length()))
    counts = texts.mapInPandas(_slot_counts(bits, shard_words), "slice int, counts binary")
    slices = counts.repartition(shuffle_partitions(texts.sparkSession), "slice").mapInPandas(_slice_bits(least), "slice int, bits binary")
    table = np.zeros((1 << bits >> SLICE_BITS, 1 << SLICE_BITS >> 3), np.uint8)
    for row in slices.toLocalIterator():  # 2**bits / 8 bytes at most
        table[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return bits, table.reshape(-1)


def _set_in(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def levels(shard: Shard, bits: int, bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trie of a shard, level by level: (parent, word, count) of its nodes, in the order of their words. Level 0 is the languages."""
    word, pair, here, both = slots(shard, bits)
    rank = np.empty(len(shard.words), np.int64)
    rank[sorted(range(len(shard.words)), key=shard.words.__getitem__)] = np.arange(len(shard.words))
    at = np.flatnonzero(here[: shard.starts])
    node, parent, number = np.unique(shard.lang[at], return_inverse=True, return_counts=True)
    yield np.zeros(len(node), np.int64), node, number
    by_rank = np.argsort(rank)
    for depth in range(DEPTH):
        kept = _set_in(bitmap, word[at]) if depth == 0 else both[at + depth - 1]
        at, parent = at[kept], parent[kept]
        if depth:
            kept = _set_in(bitmap, pair[at + depth - 1])
            at, parent = at[kept], parent[kept]
        node, back, number = np.unique(parent * len(rank) + rank[shard.ids[at + depth]], return_inverse=True, return_counts=True)
        yield node // len(rank), by_rank[node % len(rank)], number
        parent = back


def nodes_of(shard: Shard, bits: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paths, counts) of all nodes of a shard's trie: language, then DEPTH numbers of words (-1 past the end)."""
    paths, counts, above = [], [], None
    for depth, (parent, word, number) in enumerate(levels(shard, bits, bitmap)):
        if depth == 0:
            above = np.full((len(word), DEPTH + 1), -1, np.int64)
        else:
            above = above[parent]
        above[:, depth] = word
        paths.append(above)
        counts.append(number)
        above = above.copy()
    return np.concatenate(paths), np.concatenate(counts)


def serialised(paths: np.ndarray, counts: np.ndarray, words: list[str], names: list[str]) -> bytes:
    """Nodes in the order of their paths: the words that occur, then the columns of the paths and the counts, byte by byte."""
    used = np.unique(paths[:, 1:])
    used = used[used >= 0]
    own = sorted(words[i] for i in used)
    place = dict(zip(own, range(len(own)), strict=True))
    local = np.full(len(words) + 1, -1, np.int64)
    local[used] = [place[words[i]] for i in used]
    langs = sorted({names[i] for i in paths[:, 0]})
    of_lang = np.array([langs.index(x) if x in langs else -1 for x in names])
    table = np.column_stack([of_lang[paths[:, 0]], local[paths[:, 1:]]]) + 1
    order = np.lexsort(table.T[::-1])
    table = np.column_stack([table[order], counts[order]]).astype("<u4")
    planes = np.ascontiguousarray(table.T).view(np.uint8).reshape(table.shape[1], -1, 4).transpose(0, 2, 1)
    head = "\n".join([" ".join(own), *langs]).encode()
    return zlib.compress(len(head).to_bytes(4, "little") + head + planes.tobytes(), 1)


def deserialised(body: bytes) -> tuple[np.ndarray, list[str], list[str]]:
    """(columns of the paths from 1, 0 past the end, and counts; words; languages)."""
    data = zlib.decompress(body)
    size = int.from_bytes(data[:4], "little")
    words, *langs = data[4 : 4 + size].decode().split("\n")
    planes = np.frombuffer(data, np.uint8, offset=4 + size).reshape(DEPTH + 2, 4, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view("<u4")[..., 0].T.astype(np.int64), words.split(" ") if words else [], langs


def merged(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """(paths, counts, words, languages): the sorted runs merged, equal nodes added up."""
    runs = [deserialised(b) for b in bodies]
    words, langs = (sorted(set().union(*(r[i] for r in runs))) for i in (1, 2))
    number = [{x: i + 1 for i, x in enumerate(own)} for own in (words, langs)]
    tables = []
    for table, own, names in runs:
        word = np.array([0, *(number[0][x] for x in own)])
        lang = np.array([0, *(number[1][x] for x in names)])
        tables.append(np.column_stack([lang[table[:, 0]], word[table[:, 1:-1]], table[:, -1]]))
    table = np.concatenate(tables)
    table = table[np.lexsort(table[:, :-1].T[::-1])]
    first = np.flatnonzero(np.concatenate([[True], (table[1:, :-1] != table[:-1, :-1]).any(axis=1)]))
    return table[first, :-1], np.add.reduceat(table[:, -1], first), words, langs


def walked(paths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[node, k]: the count of the first k words of each node's path; -1 where that node lies before the run."""
    depth = (paths[:, 1:] > 0).sum(axis=1)
    at = np.arange(len(paths))
    lefts = np.full((len(paths), DEPTH), -1, np.int64)
    for k in range(DEPTH):
        last = np.maximum.accumulate(np.where(depth == k, at, -1))
        above = (depth > k) & (last >= 0)
        above[above] = (paths[last[above], : k + 1] == paths[above, : k + 1]).all(axis=1)
        lefts[above, k] = counts[last[above]]
    return lefts


def _tries(size: int, sent: Shared):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, bitmap, splitters = sent.value
        for shard in shards(frames, size):
            paths, counts = nodes_of(shard, bits, bitmap)
            words = [w.decode() if i else "" for i, w in enumerate(shard.words)]
            place = _places(paths, splitters, words, shard.names)
            order = np.argsort(place, kind="stable")
            cut = np.flatnonzero(np.diff(place[order], prepend=-1))
            rows = [(place[own[0]], serialised(paths[own], counts[own], words, shard.names)) for own in np.split(order, cut[1:])] if len(order) else []
            if rows:
                yield pd.DataFrame(rows, columns=["range", "body"])

    return count


def _places(paths: np.ndarray, splitters: list[tuple], words: list[str], names: list[str]) -> np.ndarray:
    """The range of each node: how many splitters aren't after its path. Splitters are looked for by the ranks of this shard's words."""
    by_word, by_name = sorted(set(words[1:])), sorted(set(names))
    rank = np.array([-1, *np.searchsorted(by_word, words[1:]), -1], np.int64) if by_word else np.full(len(words) + 1, -1, np.int64)
    own = np.column_stack([np.searchsorted(by_name, names)[paths[:, 0]], rank[paths[:, 1:]]])
    # a splitter's word that the shard doesn't have lies between two ranks
    cuts = [[_between(by_name, lang), *(_between(by_word, w) for w in path), *[-1.0] * (DEPTH - len(path))] for lang, path in splitters]
    both = np.concatenate([np.array(cuts).reshape(-1, DEPTH + 1), own])
    order = np.lexsort([np.repeat([0, 1], [len(cuts), len(own)]), *both.T[::-1]])
    seen = np.cumsum(order < len(cuts))
    out = np.empty(len(both), np.int64)
    out[order] = seen
    return out[len(cuts) :]


def _between(ranked: list[str], x: str) -> float:
    at = bisect.bisect_left(ranked, x)
    return float(at) if at < len(ranked) and ranked[at] == x else at - 0.5


def _sampled(size: int, sent: Shared):
    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, bitmap = sent.value
        for shard in shards(frames, size):
            paths, _ = nodes_of(shard, bits, bitmap)
            own = [" ".join(shard.words[i].decode() for i in path[1:] if i >= 0) for path in paths]
            if own:
                yield pd.DataFrame({"lang": [shard.names[i] for i in paths[:, 0]], "path": own})

    return sample


def _splitters(texts: DataFrame, found: Shared, ranges: int, size: int) -> list[tuple]:
    """Paths that cut the nodes into about ``ranges`` even ranges, from a sample in proportion to them; the driver gets SAMPLE_A_RANGE paths a range."""
    sample = hash_sample(texts, ["lang", "text"], SAMPLE_TEXTS_A_RANGE * ranges).mapInPandas(_sampled(size, found), "lang string, path string").distinct()
    own = sorted((r["lang"], tuple(r["path"].split(" ")) if r["path"] else ()) for r in hash_sample(stored(sample, "sample"), ["lang", "path"], SAMPLE_A_RANGE * ranges).collect())
    return sorted({own[len(own) * i // ranges] for i in range(1, ranges)}) if own else []


def _merge(least: int):
    def one(bodies: list[bytes]) -> Iterator[pd.DataFrame]:
        paths, counts, words, langs = merged(bodies)
        kept = (counts >= least) | (paths[:, 1] == 0)
        paths, counts = paths[kept], counts[kept]
        lefts = walked(paths, counts)
        depth = (paths[:, 1:] > 0).sum(axis=1)
        if not len(paths):
            return
        yield pd.DataFrame({
            "lang": [langs[i - 1] for i in paths[:, 0]], "words": [[words[i - 1] for i in path[:d]] for path, d in zip(paths[:, 1:].tolist(), depth.tolist(), strict=True)], "f": counts,
            "lefts": [[None if x < 0 else x for x in left[:d]] for left, d in zip(lefts.tolist(), depth.tolist(), strict=True)],
        })

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, bodies = None, []
        for pdf in frames:
            for own, body in zip(pdf["range"].tolist(), pdf["body"], strict=True):
                if own != at and bodies:
                    yield from one(bodies)
                    bodies = []
                at = own
                bodies.append(body)
        if bodies:
            yield from one(bodies)

    return merge


def frequent(docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, words, f, lefts): all phrases of up to DEPTH words with f >= least, and each language's root with its number of words."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found = pair_filter(texts, least, shard_words)
    parts = shuffle_partitions(spark)
    splitters = _splitters(texts, Shared(spark, found), min(RANGES_A_PARTITION * parts, MOST_RANGES), shard_words)
    blocks = texts.mapInPandas(_tries(shard_words, Shared(spark, (*found, splitters))), "range int, body binary")
    runs = blocks.repartition(parts, "range").sortWithinPartitions("range")
    return stored(runs.mapInPandas(_merge(least), f"{NODES}, lefts array<long>"), "frequent")


def _phrase(words) -> F.Column:
    return F.array_join(words, " ")


def scored(counts: DataFrame, scale: int = 1000) -> DataFrame:
    """(lang, words, phrase, a, lefts, rights, n, k, l, r, score) of every phrase of two words or more: the lowest-scoring cut."""
    counts = counts.withColumn("phrase", _phrase("words"))
    phrases = counts.where(F.size("words") >= 2)
    cuts = list(range(1, DEPTH))
    inside = lambda k: F.lit(k) < F.size("words")
    right = [F.when(inside(k), F.struct(F.lit(f"r{k}").alias("side"), _phrase(F.expr(f"slice(words, {k + 1}, {DEPTH})")).alias("part"))) for k in cuts]
    left = [F.when(inside(k) & F.get("lefts", F.lit(k)).isNull(), F.struct(F.lit(f"l{k}").alias("side"), _phrase(F.slice("words", 1, k)).alias("part"))) for k in cuts]
    asked = phrases.select("lang", "phrase", "words", "lefts", F.col("f").alias("a"), F.explode(F.array_compact(F.array(*right, *left))).alias("need"))
    links = counts.where(F.size("words") >= 1).select("lang", F.col("phrase").alias("part"), F.col("f").alias("found"))
    met = asked.select("*", "need.side", "need.part").drop("need").join(links, ["lang", "part"])
    sides = [F.max(F.when(F.col("side") == f"{s}{k}", F.col("found"))).alias(f"{s}{k}") for s in "lr" for k in cuts]
    whole = met.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.first("lefts").alias("lefts"), *sides)
    roots = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    whole = whole.join(roots, "lang").withColumns({f"l{k}": F.coalesce(F.get("lefts", F.lit(k)), f"l{k}") for k in cuts})
    exact = lambda x: f"CAST({x} AS DECIMAL(38,0))"
    ways = [F.when(inside(k), F.struct(F.expr(f"({exact(scale)} * {exact('a')} * {exact('n')}) div ({exact(f'l{k}')} * {exact(f'r{k}')})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts]
    best = whole.withColumn("best", F.array_min(F.array_compact(F.array(*ways))))
    last = lambda side, at: F.element_at(F.array_compact(F.array(*[F.when(inside(k), F.col(f"{side}{k}")) for k in cuts])), at)
    return best.select("lang", "words", "phrase", "a", "n", "best.*", last("l", -1).alias("shorter_left"), last("r", 1).alias("shorter_right"))


def ranked(docs: DataFrame, least: int = 100, keep: int = 2000, absorb_percent: int = 100, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``keep`` phrases by score, then count, then phrase.

    A phrase goes if a longer one with at least ``absorb_percent`` percent of its count holds it.
    """
    found = stored(scored(frequent(docs, least, lang_col, text_col, shard_words)), "scored")
    shorter = [
        F.when(F.col("a") * 100 >= F.col("shorter_left") * absorb_percent, _phrase(F.expr("slice(words, 1, size(words) - 1)"))),
        F.when(F.col("a") * 100 >= F.col("shorter_right") * absorb_percent, _phrase(F.expr(f"slice(words, 2, {DEPTH})"))),
    ]
    absorbed = found.where(F.size("words") > 2).select("lang", F.explode(F.array_compact(F.array(*shorter))).alias("phrase")).distinct()
    left = found.join(absorbed, ["lang", "phrase"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= keep).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
