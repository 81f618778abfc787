"""Joins of the engine: reconciliation, coverage, overlap, adjacency, differences, upserts.

Theta conditions always come with an equality (a row, a page, a bucket), so
every join is a hash or sort-merge join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_reconcile(declared: DataFrame, facts: DataFrame, key: str, declared_count: str) -> DataFrame:
    """(key, declared, actual, status): facts are counted by key before the join."""
    actual = facts.groupBy(key).agg(F.count("*").alias("actual"))
    both = declared.select(key, F.col(declared_count).cast("long").alias("declared")).join(actual, key, "left").na.fill(0, ["actual"])
    return both.withColumn("status", F.when(F.col("declared") == F.col("actual"), "current").otherwise("corrupt"))


def exact_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, left_rows, right_rows, status) by key over both sides: matched only if each side has exactly one row."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(left, "left_rows").join(count(right, "right_rows"), keys, "full_outer").na.fill(0, ["left_rows", "right_rows"])
    status = F.when(F.col("right_rows") == 0, "left_only").when(F.col("left_rows") == 0, "right_only").when((F.col("left_rows") == 1) & (F.col("right_rows") == 1), "matched").otherwise("not_unique")
    return both.withColumn("status", status)


def full_outer_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys…, status, changed) for rows of either side: MATCH, WRONG (and the columns that differ), MISSING or EXTRA."""
    a = left.select(*keys, F.struct(*values).alias("l"))
    b = right.select(*keys, F.struct(*values).alias("r"))
    both = a.join(b, keys, "full_outer")
    differs = F.concat_ws(",", *(F.when(~F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}")), F.lit(v)) for v in values))
    status = F.when(F.col("r").isNull(), "MISSING").when(F.col("l").isNull(), "EXTRA").when(differs == "", "MATCH").otherwise("WRONG")
    return both.select(*keys, status.alias("status"), F.when(status == "WRONG", differs).alias("changed"))


def merge_upsert(base: DataFrame, delta: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """Base with delta merged in: equal values stay, a row of higher rank supersedes, another is a conflict, new ones are added."""
    a = base.select(*keys, F.struct(value, rank).alias("l"))
    b = delta.select(*keys, F.struct(value, rank).alias("r"))
    action = (
        F.when(F.col("r").isNull(), "unchanged").when(F.col("l").isNull(), "added").when(F.col(f"l.{value}").eqNullSafe(F.col(f"r.{value}")), "unchanged")
        .when(F.col(f"r.{rank}") > F.col(f"l.{rank}"), "superseded").otherwise("conflict")
    )
    taken = F.when(action.isin("added", "superseded"), F.col("r")).otherwise(F.col("l"))
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"), taken[value].alias(value))


def boxes_touching(left: DataFrame, right: DataFrame, group: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of intervals [low, high] of a group that overlap. Intervals are cut into buckets of ``width``; a pair is
    reported in the first bucket that both are in, so none twice."""
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    cut = lambda df, side: df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns), first.alias(f"{side}_first"), F.explode(F.sequence(first, last)).alias("bucket"))
    a, b = cut(left, "l"), cut(right, "r")
    met = (F.col(f"l_{group}") == F.col(f"r_{group}")) & (a["bucket"] == b["bucket"])
    overlap = (F.col(f"l_{low}") <= F.col(f"r_{high}")) & (F.col(f"r_{low}") <= F.col(f"l_{high}")) & (a["bucket"] == F.greatest("l_first", "r_first"))
    return a.join(b, met & overlap).drop("bucket", "l_first", "r_first")


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x0, top, x1, bottom)."""
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    common = width * height
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def touching_totals(boxes: DataFrame, group: str, key: str, sides: list[str], width: float) -> DataFrame:
    """(group, pairs, best): unordered pairs of boxes (sides: x0, top, x1, bottom) of a group whose x intervals overlap and whose keys
    differ, and the largest intersection over union among them.

    Equal boxes are one counted box before any join, so only different boxes meet, and copies cost nothing. Pairs of rows
    that share a key are counted the same way within the keys that several rows have, and taken off. Null keys pair with nothing.
    """
    low, high = sides[0], sides[2]
    rows = boxes.where(F.col(key).isNotNull() & F.col(group).isNotNull()).groupBy(group, key, *sides).agg(F.count("*").alias("n"))
    box = lambda s: F.struct(*(f"{s}_{c}" for c in sides))
    pairs = F.when(box("l").eqNullSafe(box("r")), (F.col("l_n") * (F.col("l_n") - 1) / 2).cast("long")).otherwise(F.col("l_n") * F.col("r_n"))
    meeting = lambda counted, by: boxes_touching(counted, counted, by, low, high, width).where(box("l") <= box("r")).withColumn("pairs", pairs)
    counted = rows.groupBy(group, *sides).agg(F.sum("n").alias("n"), F.min(key).alias("least"), F.max(key).alias("most"))
    differ = F.least("l_least", "r_least") < F.greatest("l_most", "r_most")
    best = F.max(F.when(differ, box_iou([F.col(f"l_{c}") for c in sides], [F.col(f"r_{c}") for c in sides])))
    met = meeting(counted, group).groupBy(F.col(f"l_{group}").alias(group)).agg(F.sum("pairs").alias("pairs"), best.alias("best"))
    repeated = rows.groupBy(group, key).agg(F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    own = rows.join(repeated, [group, key]).select(F.struct(group, key).alias("of"), *sides, "n")
    alike = meeting(own, "of").groupBy(F.col(f"l_of.{group}").alias(group)).agg(F.sum("pairs").alias("alike"))
    left = F.col("pairs") - F.coalesce("alike", F.lit(0))
    return met.join(alike, group, "left").select(group, left.alias("pairs"), "best").where("pairs > 0")


def adjacent(df: DataFrame, group: str, ordinal: str, accept: Column) -> DataFrame:
    """(group, left, right) for rows and the rows at the next ordinal that ``accept`` (on l and r structs) takes, where the
    choice is unique on both sides."""
    row = F.struct(*df.columns)
    a = df.select(F.col(group), F.col(ordinal).alias("at"), row.alias("l"))
    b = df.select(F.col(group), (F.col(ordinal) - 1).alias("at"), row.alias("r"))
    pairs = a.join(b, [group, "at"]).where(accept)
    by = lambda side: F.count("*").over(Window.partitionBy(group, side))
    return pairs.withColumns({"n_left": by("l"), "n_right": by("r")}).where("n_left = 1 AND n_right = 1").select(group, "l", "r")


def demand_matches(demands: DataFrame, facts: DataFrame, kind: str = "kind", required: str = "required_roles", present: str = "roles") -> DataFrame:
    """Facts joined to the demands of their kind whose required roles they all have."""
    return facts.join(demands, kind).where(F.size(F.array_except(required, present)) == 0)


def first_of(base: DataFrame, key: str, sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``base`` with source and value from the first of the sources (name, table, value column) that has the key; else the source is gap."""
    names = []
    for i, (_, table, value) in enumerate(sources):
        names.append(f"__v{i}")
        base = base.join(table.groupBy(key).agg(F.min(value).alias(names[-1])), key, "left")
    source = reduce(lambda rest, i: F.when(F.col(names[i]).isNotNull(), sources[i][0]).otherwise(rest), reversed(range(len(names))), F.lit("gap"))
    return base.withColumns({"source": source, "value": F.coalesce(*names)}).drop(*names)


def cell_diff(left: DataFrame, right: DataFrame, group: str, row: str, col: str, text: str) -> DataFrame:
    """(group, row, col, status) of cells: same, text, omitted, extra, or moved (the text stands at another cell of the group)."""
    both = left.select(group, row, col, F.col(text).alias("__l"), F.lit(True).alias("__in_left")).join(right.select(group, row, col, F.col(text).alias("__r"), F.lit(True).alias("__in_right")), [group, row, col], "full_outer")
    there = right.select(group, F.col(text).alias("__l")).distinct().withColumn("__elsewhere", F.lit(True))
    status = (
        F.when(F.col("__in_left").isNull(), "extra").when(F.col("__in_right").isNotNull() & F.col("__l").eqNullSafe(F.col("__r")), "same")
        .when(F.col("__elsewhere"), "moved").when(F.col("__in_right").isNull(), "omitted").otherwise("text")
    )
    return both.join(there, [group, "__l"], "left").select(group, row, col, status.alias("status"))


def set_coverage(selected: DataFrame, decided: DataFrame, no_fact: DataFrame, key: str) -> DataFrame:
    """One row: whether decided and no_fact are disjoint and together make up selected, with the sizes of what is wrong."""
    tag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(1))
    all_keys = tag(selected, "s").join(tag(decided, "d"), key, "full_outer").join(tag(no_fact, "n"), key, "full_outer")
    counts = all_keys.agg(
        F.count_if(F.expr("s = 1 AND d IS NULL AND n IS NULL")).alias("uncovered"),
        F.count_if(F.expr("d = 1 AND n = 1")).alias("in_both"),
        F.count_if(F.expr("s IS NULL")).alias("unselected"),
    )
    return counts.withColumn("complete", F.expr("uncovered + in_both + unselected = 0"))


def overlap_totals(spans: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """(group, pairs, length): ordered pairs of closed integer intervals that meet, each with itself, and the length they share.

    Two intervals meet unless one ends before the other begins, so pairs are all n * n less twice those: for each begin, the
    ends before it, a running count. The shared length is the sum over unit steps of the square of how many
    intervals cover the step; the number only changes at cut points, which are counted once a group before any window.
    """
    marks = spans.select(group, F.explode(F.array(F.struct(F.col(low).alias("at"), F.lit(1).alias("begins"), F.lit(0).alias("ends")), F.struct(F.col(high).alias("at"), F.lit(0).alias("begins"), F.lit(1).alias("ends")))).alias("m"))
    cuts = marks.groupBy(group, "m.at").agg(F.sum("m.begins").alias("begins"), F.sum("m.ends").alias("ends"))
    w = Window.partitionBy(group).orderBy("at")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.sum(F.col("begins") - F.col("ends")).over(upto)
    steps = cuts.withColumns({"ended": F.coalesce(F.sum("ends").over(before), F.lit(0)), "open": open_, "width": F.coalesce(F.lead("at").over(w) - F.col("at"), F.lit(0))})
    sums = steps.groupBy(group).agg(F.sum("begins").alias("n"), F.sum(F.col("begins") * F.col("ended")).alias("apart"), F.sum(F.col("open") * F.col("open") * F.col("width")).alias("length"))
    return sums.select(group, (F.col("n") * F.col("n") - 2 * F.col("apart")).alias("pairs"), "length")
