"""Order-dependent operators: islands, interval unions, lots, bands, components, packing, clusters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, which has to be total."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def islands(df: DataFrame, group: str, order: list[str], key: Column, most: int | None = None) -> DataFrame:
    """``df`` with island: the number of the run of equal keys within the group; runs longer than ``most`` are cut."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = df.withColumn("__key", key).withColumn("__new", F.when(F.lag("__key").over(w).eqNullSafe(F.col("__key")) & (F.row_number().over(w) > 1), 0).otherwise(1))
    out = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if most:
        within = F.row_number().over(Window.partitionBy(group, "island").orderBy(*order))
        out = out.withColumn("part", F.floor((within - 1) / most))
    return out.drop("__key", "__new")


def interval_islands(df: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """(group, begin, end, n): overlapping or touching intervals merged."""
    w = Window.partitionBy(group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.withColumn("__top", F.max(high).over(w)).withColumn("__new", F.when(F.col("__top") >= F.col(low), 0).otherwise(1))
    numbered = starts.withColumn("__island", F.sum("__new").over(Window.partitionBy(group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(group, "__island").agg(F.min(low).alias("begin"), F.max(high).alias("end"), F.count("*").alias("n")).drop("__island")


def covered_days(df: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """(group, days): distinct days in the union of closed date intervals. Intervals are merged, so no day is listed."""
    merged = interval_islands(df.where(F.col(low) <= F.col(high)).select(group, low, F.date_add(high, 1).alias("__after")), group, low, "__after")
    return merged.groupBy(group).agg(F.sum(F.datediff("end", "begin")).alias("days"))


def band_charge(df: DataFrame, base: str, bands: list[tuple[str, str | None, str]]) -> list[Column]:
    """tax and band number of a progressive schedule: band i holds lower < base <= upper (upper None: no end); tax is the
    sum over the bands below and the part of the base in this one, rounded half up to whole units."""
    dec = lambda x: F.lit(x).cast("decimal(20,2)")
    number, tax, below = F.lit(None).cast("int"), F.lit(None).cast("decimal(30,6)"), F.lit(0).cast("decimal(30,6)")
    b = F.col(base).cast("decimal(20,2)")
    for i, (lower, upper, rate) in enumerate(bands):
        inside = (b > dec(lower)) & (b <= dec(upper) if upper is not None else F.lit(True))
        number = F.when(inside, F.lit(i)).otherwise(number)
        tax = F.when(inside, (below + (b - dec(lower)) * F.lit(rate).cast("decimal(5,4)")).cast("decimal(30,6)")).otherwise(tax)
        if upper is not None:
            below = (below + (dec(upper) - dec(lower)) * F.lit(rate).cast("decimal(5,4)")).cast("decimal(30,6)")
    return [F.coalesce(F.round(tax, 0), F.lit(0)).cast("decimal(20,0)").alias("tax"), number.alias("band")]


def fifo_matches(rows: DataFrame, group: str, order: list[str], is_buy: Column, quantity: str, ref: str) -> DataFrame:
    """(group, buy_ref, sell_ref, matched, rest): sells take the earliest buys of their group; rest is what a match leaves of its buy.

    Cumulative quantities turn lots into intervals of one line, and a match is an
    overlap of a buy's and a sell's interval. Both kinds of interval cut the line
    at their ends; each piece between two neighbouring cuts lies in one buy and
    one sell, found by the first end at or after it. So no pair of lots is ever
    joined: a window over the cuts does it in one sort.
    """
    side = F.when(is_buy, "buy").otherwise("sell")
    w = Window.partitionBy(group, "side").orderBy(*order, ref).rowsBetween(Window.unboundedPreceding, 0)
    # lots of nothing, or less, are no lots
    ends = rows.where(F.col(quantity) > 0).withColumn("side", side).withColumn("upto", F.sum(quantity).over(w))
    line = Window.partitionBy(group).orderBy(F.desc("upto"))
    cuts = ends.groupBy(group, "upto").agg(F.max(F.when(F.col("side") == "buy", F.col(ref))).alias("buy"), F.max(F.when(F.col("side") == "sell", F.col(ref))).alias("sell"))
    # from the far end: the last end met so far, in a frame that only grows
    met = line.rowsBetween(Window.unboundedPreceding, 0)
    found = cuts.withColumns({
        "from": F.coalesce(F.lead("upto").over(line), F.lit(0)),
        "buy_ref": F.last("buy", ignorenulls=True).over(met),
        "sell_ref": F.last("sell", ignorenulls=True).over(met),
        "rest": F.last(F.when(F.col("buy").isNotNull(), F.col("upto")), ignorenulls=True).over(met) - F.col("upto"),
    })
    return found.where("buy_ref IS NOT NULL AND sell_ref IS NOT NULL").select(group, "buy_ref", "sell_ref", (F.col("upto") - F.col("from")).alias("matched"), "rest")


def basis_gaps(rows: DataFrame, group: str, is_buy: Column, quantity: str) -> DataFrame:
    """(group, bought, sold, uncovered): what sells have beyond all buys."""
    sums = rows.groupBy(group).agg(F.sum(F.when(is_buy, F.col(quantity)).otherwise(0)).alias("bought"), F.sum(F.when(is_buy, 0).otherwise(F.col(quantity))).alias("sold"))
    return sums.withColumn("uncovered", F.greatest(F.col("sold") - F.col("bought"), F.lit(0)))


def connected(edges: DataFrame, save: Callable[[DataFrame], DataFrame], rounds: int = 64) -> DataFrame:
    """(node, component) over undirected edges (a, b): nodes take the least label around them and then that label's own
    label, until nothing changes. ``save`` writes a round and reads it back, which cuts the lineage."""
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        nearer = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("least", "label")).alias("least"))
        jump = labels.select(F.col("node").alias("hop"), F.col("label").alias("hop_label"))
        jumped = nearer.join(jump, nearer["least"] == jump["hop"], "left").select("node", "label", F.least("least", F.coalesce("hop_label", "least")).alias("new"))
        done = save(jumped)
        labels = done.select("node", F.col("new").alias("label"))
        if not done.where("new <> label").limit(1).count():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def greedy_bins(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """(group, order, bin): items in order, a new bin where one doesn't fit; an item beyond the budget has a bin of its own.

    The fold depends on every item before it, so a group is one pandas call; groups are documents or tables.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        bins, number, filled = [], 0, 0
        for n in pdf[size].fillna(0).tolist():
            if filled and filled + n > budget:
                number, filled = number + 1, 0
            bins.append(number)
            filled += n
        return pdf[[group, order]].assign(bin=bins)

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(group, order, size).groupBy(group).applyInPandas(fold, f"{group} {kind[group]}, {order} {kind[order]}, bin int")


def _folded(df: DataFrame, group: str, value: str, tolerance: float, label: str, fold) -> DataFrame:
    """``df`` (without rows whose value is null) with the label that ``fold`` gives to each value of a group.

    fold: ascending distinct values and their counts to labels from 0. Equal values get one label, and none is shared across a gap wider than the
    tolerance. So values are counted first, a group is cut at such gaps, and the labels of a cut begin after those of the cuts before it:
    a fold has the distinct values of one cut, however many rows there are.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy(value)
    gap = F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    cut = counts.withColumn("__gap", gap).withColumn("__cut", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(value)
        labels = fold(own[value].tolist(), own["__n"].tolist())
        return own[[group, value, "__cut"]].assign(__label=labels, __labels=max(labels) + 1)

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    found = cut.groupBy(group, "__cut").applyInPandas(each, f"{group} {kind[group]}, {value} {kind[value]}, __cut long, __label int, __labels int")
    before = Window.partitionBy(group).orderBy("__cut").rangeBetween(Window.unboundedPreceding, -1)
    of_cut = F.when(F.row_number().over(Window.partitionBy(group, "__cut").orderBy(value)) == 1, F.col("__labels")).otherwise(0)
    placed = found.withColumn("__of_cut", of_cut).withColumn(label, (F.col("__label") + F.coalesce(F.sum("__of_cut").over(before), F.lit(0))).cast("int"))
    same = F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}")) & (F.col(f"l.{value}") == F.col(f"r.{value}"))
    return df.alias("l").join(placed.select(group, value, label).alias("r"), same).select("l.*", f"r.{label}")


def running_mean_clusters(df: DataFrame, group: str, value: str, tolerance: float) -> DataFrame:
    """(group, value, cluster): values in ascending order join the first cluster whose running mean is within the tolerance."""

    def fold(values: list[float], counts: list[int]) -> list[int]:
        means: list[list[float]] = []
        out = []
        for x, m in zip(values, counts, strict=True):
            for i, (total, n) in enumerate(means):
                if abs(x - total / n) <= tolerance:  # the mean moves towards x, so all of its copies join
                    means[i] = [total + m * x, n + m]
                    out.append(i)
                    break
            else:
                means.append([m * x, m])
                out.append(len(means) - 1)
        return out

    return _folded(df.select(group, value), group, value, tolerance, "cluster", fold)


class _Line:
    """Ascending tops of a line and their median, whose place only moves on."""

    def __init__(self):
        self.tops: list[float] = []
        self.ends: list[int] = []
        self.at = 0

    def add(self, x: float, m: int) -> None:
        self.tops.append(x)
        self.ends.append((self.ends[-1] if self.ends else 0) + m)
        while self.ends[self.at] <= self.ends[-1] // 2:
            self.at += 1

    @property
    def median(self) -> float:
        return self.tops[self.at]


def median_lines(df: DataFrame, group: str, top: str, ordinal: str, tolerance: float) -> DataFrame:
    """(group, ordinal, line): words from top to bottom join the newest line whose median top is within the tolerance."""

    def fold(values: list[float], counts: list[int]) -> list[int]:
        lines: list[_Line] = []
        out = []
        for x, m in zip(values, counts, strict=True):
            i = next((i for i in range(len(lines) - 1, -1, -1) if abs(x - lines[i].median) <= tolerance), len(lines))
            if i == len(lines):
                lines.append(_Line())
            lines[i].add(x, m)  # the median moves towards x, so all of its copies join
            out.append(i)
        return out

    return _folded(df.select(group, ordinal, top), group, top, tolerance, "line", fold).select(group, ordinal, "line")


def gap_blocks(df: DataFrame, group: str, top: str, bottom: str, least_gap: float = 12.0, share: float = 1.8) -> DataFrame:
    """``df`` with block: a gap above ``share`` median heights, and above ``least_gap``, starts a new one."""
    w = Window.partitionBy(group).orderBy(top, bottom)
    medians = df.groupBy(group).agg(F.expr(f"percentile({bottom} - {top}, 0.5)").alias("__median"))
    gap = F.col(top) - F.lag(bottom).over(w)
    marked = df.join(medians, group).withColumn("__new", F.when(gap > F.greatest(F.lit(least_gap), share * F.col("__median")), 1).otherwise(0))
    return marked.withColumn("block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new", "__median")


def balanced_ranges(df: DataFrame, group: str, order: list[str], most_rows: int) -> DataFrame:
    """``df`` with range: the fewest ranges of at most ``most_rows`` rows, their sizes a row apart at most (longer ones first)."""
    n, at = F.count("*").over(Window.partitionBy(group)), F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    sized = df.withColumns({"__n": n, "__at": at}).withColumn("__k", F.ceil(F.col("__n") / most_rows))
    small, larger = F.floor(F.col("__n") / F.col("__k")), F.col("__n") % F.col("__k")
    edge = larger * (small + 1)
    place = F.when(F.col("__at") < edge, F.floor(F.col("__at") / (small + 1))).otherwise(larger + F.floor((F.col("__at") - edge) / small))
    return sized.withColumn("range", place.cast("long")).drop("__n", "__at", "__k")


def dense_ordinals(df: DataFrame, group: str, ordinal: str, empty: Column) -> DataFrame:
    """Rows that aren't empty with dense new ordinals from 0."""
    kept = df.where(~empty)
    return kept.withColumn("dense", F.dense_rank().over(Window.partitionBy(group).orderBy(ordinal)) - 1)


def offset_concat(df: DataFrame, group: str, window: str, size: str) -> DataFrame:
    """``df`` (a row for each window of a group) with offset: the sizes of the windows before."""
    w = Window.partitionBy(group).orderBy(window).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))
