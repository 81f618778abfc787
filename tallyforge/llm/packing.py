"""Best-fit packing of token sequences by a configuration linear program.

1. Documents are tokenized and cut where they are longer than a sequence; the
   pieces are written once, numbered within task and length.
2. The histogram of lengths (at most ``capacity`` rows) goes to the driver. The
   configuration program asks for the fewest sequences whose patterns cover all
   counts; multiplicative weights solve it. In each round a knapsack dynamic program
   over the prices (the weights) gives the worth of every room, and with it the dual's
   bound; patterns are read off that table, from the longest length left on, and bought
   in whole numbers while they are worth nearly as much as the dearest, so a round's purchases
   are already rounded. What no such pattern holds goes to best fit. Lengths that the purchases
   didn't cover, or only in patterns that leave room, gain weight against the others. Rounds end at the gap to the bound or after
   ROUNDS; the fewest sequences count.
3. A piece's rank among its length is the number in its task plus that of earlier
   tasks; the patterns' slots, a bounded table, give its sequence and offset.

Defined results for odd input: a null or empty text is a document of the end id
alone; an empty table gives no rows; repeated rows are packed each time; null
ids stay null. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, stored
from .vocabularies import Lazy

CAPACITY = 2048
ROUNDS = 40
RATE = 0.2
GAP = 0.002
#: A pattern is bought if it is worth all but so much of the dearest one.
SLACKS = (0.002, 0.01, 0.03)
PIECE = "id {id}, piece int, start long, length long, ids_crc32 long, part int, rank long"


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length): full sequences, but for a shorter first piece."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def worths(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The worth of the dearest multiset of lengths within each room: unbounded knapsack by dynamic programming. lengths ascend."""
    best = np.zeros(capacity + 1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        k = fitting[c]
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + prices[:k]).max())
    return best


def pattern_with(first: int, lengths: np.ndarray, prices: np.ndarray, best: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """(numbers of each length's pieces, worth): a pattern with the length at place ``first``, filled along the table of worths with what is left."""
    used = np.zeros(len(lengths), np.int64)
    used[first] = 1
    room, worth = capacity - int(lengths[first]), float(prices[first])
    while room >= lengths[0]:
        k = int(np.searchsorted(lengths, room, "right"))
        value = np.where(left[:k] > used[:k], best[room - lengths[:k]] + prices[:k], -1.0)
        i = k - 1 - int(value[::-1].argmax())  # of equals, the longest
        if value[i] < 0:
            break
        used[i] += 1
        room, worth = room - int(lengths[i]), worth + float(prices[i])
    return used, worth


def purchases(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray, float]:
    """(patterns and times, what they leave of each length, the dual's bound) at the given prices."""
    left, out, bound = counts.copy(), [], 0.0
    for slack in SLACKS:
        bought = True
        while bought and left.any():
            bought = False
            open_ = np.flatnonzero(left)
            own, price = lengths[open_], prices[open_]
            best = worths(own, price, capacity)
            if not bound:
                bound = float(prices @ counts / best[capacity])
            rest = left[open_]
            for i in range(len(own) - 1, -1, -1):
                while rest[i]:
                    used, worth = pattern_with(i, own, price, best, rest, capacity)
                    if worth < (1 - slack) * best[capacity]:
                        break
                    at = np.flatnonzero(used)
                    times = int((rest[at] // used[at]).min())
                    out.append(({int(own[j]): int(used[j]) for j in at}, times))
                    rest[at] -= times * used[at]
                    bought = True
            left[open_] = rest
    return out, left, bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) by best fit in bulk: longest pieces first, all of a length at once into the sequences with the least room for them."""
    rooms: dict[int, list[tuple[Counter, int]]] = {}
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        todo = left[n]
        while todo:
            room = min((r for r, groups in rooms.items() if r >= n and groups), default=None)
            pattern, times = rooms[room].pop() if room else (Counter(), -(-todo // (capacity // n)))
            room = room or capacity
            each = min(room // n, max(1, todo // times))
            filled = min(times, todo // each)
            if filled < times and pattern:
                rooms.setdefault(room, []).append((pattern, times - filled))
            if filled:
                rooms.setdefault(room - n * each, []).append((pattern + Counter({n: each}), filled))
                todo -= filled * each
    return [(dict(p), k) for groups in rooms.values() for p, k in groups]


def sequences(solution: list[tuple[dict[int, int], int]]) -> int:
    return sum(times for _, times in solution)


def program(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], int, float]:
    """(pattern, times) in whole numbers that hold exactly the histogram's pieces, how many of the pieces the program's own patterns hold, and a lower bound of the program."""
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[n] for n in lengths.tolist()])
    prices, found, bound, own = lengths / capacity, None, 0.0, 0
    for _ in range(rounds):
        bought, left, least = purchases(lengths, counts, prices, capacity)
        whole = bought + best_fit(dict(zip(lengths.tolist(), left.tolist(), strict=True)), capacity)
        bound = max(bound, least)
        if found is None or sequences(whole) < sequences(found):
            found, own = whole, int((counts - left).sum())
        if sequences(found) <= max(np.ceil(bound - 1e-6), (1 + GAP) * bound):
            break
        room = np.zeros(len(lengths))  # that the patterns of a length leave empty, of a sequence, on average
        for pattern, times in whole:
            empty = 1 - sum(n * k for n, k in pattern.items()) / capacity
            for n, k in pattern.items():
                room[np.searchsorted(lengths, n)] += empty * times * k
        prices = prices * np.exp(RATE * (room / counts + left / counts))
        prices /= prices.max()
    return found, own, bound


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): whole patterns that hold exactly the histogram's pieces, never more than best fit alone takes."""
    left = {n: c for n, c in histogram.items() if 0 < n < capacity and c}
    full = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    if not left:
        return full
    return full + min(program(left, capacity, rounds)[0], best_fit(left, capacity), key=sequences)


def slots(solution: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies in a sequence, first sequence, offset) in order of rank."""
    rows: dict[int, list] = {}
    rank, sequence = Counter(), 0
    for pattern, times in solution:
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            rows.setdefault(n, []).append((rank[n], k, sequence, offset))
            rank[n] += times * k
            offset += n * k
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def cut_pieces(vocabulary, end_id: int, capacity: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), Counter()
        tokenizer = vocabulary.value
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = np.append(tokenizer.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for i, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    rows.append((doc, i, start, length, zlib.crc32(ids[start : start + length]), part, seen[length]))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])
            yield out.assign(id=out["id"].astype(pdf["id"].dtype))

    return cut


def packed(docs: DataFrame, vocabulary: Lazy, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = Shared(spark, vocabulary)
    pieces = stored(rows.mapInPandas(cut_pieces(sent, end_id, capacity), PIECE.format(id=rows.schema["id"].dataType.simpleString())), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = spark.sparkContext.broadcast(slots(solve(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a row for each task and length grows with the tasks: never broadcast
    ranked = pieces.join(bases.hint("merge"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank, sequence, offset = pdf["rank"].to_numpy(), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for n, own in pdf.groupby("length").indices.items():
                rows = table.value[n]
                slot = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                k = rank[own] - slot[:, 0]
                sequence[own] = slot[:, 2] + k // slot[:, 1]
                offset[own] = slot[:, 3] + k % slot[:, 1] * n
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(place, schema).withColumnRenamed("id", id_col)
