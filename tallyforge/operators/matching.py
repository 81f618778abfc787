"""One-to-one matching with a tolerance, queues of any depth, and stitching of ordered windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved


def reconciled(left: DataFrame, right: DataFrame, block: str, value: str, ref: str, tolerance: int) -> DataFrame:
    """(block, left_ref, right_ref, distance, bucket): every row of both sides once, in exact, within_tolerance, left_only or right_only.

    Rows of one block match one to one, nearest first: pairs are settled in the order of their distance, then the
    left value, the right value, the left ref and the right ref. No pair is listed that isn't settled: equal values of a side
    are one counted group, and in the order of a block's values the nearest pair of groups are neighbours, so each
    round settles all neighbours that are each other's nearest; rounds end when none is left. Rows with a
    null block or value match nothing.
    """
    keys = [block, "v"]
    named = lambda df, side: df.select(block, F.col(value).alias("v"), F.col(ref).alias("ref"), F.lit(side).alias("side"))
    rows = named(left, "l").unionByName(named(right, "r")).where(f"{block} IS NOT NULL AND v IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("ref"))
    rows = saved(rows.withColumn("place", place.cast("long")))
    count = lambda side: F.count_if(F.col("side") == side)
    # (l, r): how many of each side are left at a value; (lt, rt): how many were taken before
    state = saved(rows.groupBy(*keys).agg(count("l").alias("l"), count("r").alias("r")).withColumns({"lt": F.lit(0).cast("long"), "rt": F.lit(0).cast("long")}))
    pairs = [saved(state.where("l > 0 AND r > 0").select(block, F.col("v").alias("lv"), F.col("v").alias("rv"), "lt", "rt", F.least("l", "r").alias("n")))]
    same = F.least("l", "r")
    state = saved(state.select(*keys, (F.col("l") - same).alias("l"), (F.col("r") - same).alias("r"), (F.col("lt") + same).alias("lt"), (F.col("rt") + same).alias("rt")).where("l + r > 0"))
    up, down = Window.partitionBy(block).orderBy("v"), Window.partitionBy(block).orderBy(F.desc("v"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = down.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        lefts, rights = F.when(F.col("l") > 0, F.col("v")), F.when(F.col("r") > 0, F.col("v"))
        is_left = F.col("l") > 0
        near = state.withColumns({"below": F.when(is_left, F.last(rights, True).over(before)).otherwise(F.last(lefts, True).over(before)), "above": F.when(is_left, F.last(rights, True).over(after)).otherwise(F.last(lefts, True).over(after))})
        down_by, up_by = F.col("v") - F.col("below"), F.col("above") - F.col("v")
        best = F.when(down_by.isNotNull() & (up_by.isNull() | (down_by <= up_by)), F.when(down_by <= tolerance, F.col("below"))).otherwise(F.when(up_by <= tolerance, F.col("above")))
        near = near.withColumns({"best": best, "size": F.col("l") + F.col("r")})
        with_next = (F.col("best") == F.lead("v").over(up)) & (F.lead("best").over(up) == F.col("v"))
        with_last = (F.col("best") == F.lag("v").over(up)) & (F.lag("best").over(up) == F.col("v"))
        n = F.when(with_next, F.least("size", F.lead("size").over(up))).when(with_last, F.least("size", F.lag("size").over(up))).otherwise(0)
        other = lambda c: F.lead(c).over(up)
        step = saved(near.withColumns({"n": n, "next": F.coalesce(with_next, F.lit(False)), "next_lt": other("lt"), "next_rt": other("rt"), "next_v": other("v")}))
        found = step.where("next").select(
            block, F.when(is_left, F.col("v")).otherwise(F.col("next_v")).alias("lv"), F.when(is_left, F.col("next_v")).otherwise(F.col("v")).alias("rv"),
            F.when(is_left, F.col("lt")).otherwise(F.col("next_lt")).alias("lt"), F.when(is_left, F.col("next_rt")).otherwise(F.col("rt")).alias("rt"), "n",
        )
        if found.isEmpty():
            break
        pairs.append(found)
        took = lambda side: F.when(F.col(side) > 0, F.col("n")).otherwise(0)
        state = saved(step.select(*keys, (F.col("l") - took("l")).alias("l"), (F.col("r") - took("r")).alias("r"), (F.col("lt") + took("l")).alias("lt"), (F.col("rt") + took("r")).alias("rt")).where("l + r > 0"))
    each = reduce(DataFrame.unionByName, pairs).select(block, "lv", "rv", "lt", "rt", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    side = lambda s, v, p, name: rows.where(F.col("side") == s).select(block, F.col("v").alias(v), F.col("place").alias(p), F.col("ref").alias(name))
    each = each.select(block, "lv", "rv", (F.col("lt") + F.col("i")).alias("lp"), (F.col("rt") + F.col("i")).alias("rp"))
    met = saved(each.join(side("l", "lv", "lp", "left_ref"), [block, "lv", "lp"]).join(side("r", "rv", "rp", "right_ref"), [block, "rv", "rp"]))
    distance = F.abs(F.col("lv") - F.col("rv"))
    out = met.select(block, "left_ref", "right_ref", distance.alias("distance"), F.when(distance == 0, "exact").otherwise("within_tolerance").alias("bucket"))
    alone = lambda df, own, other_, name: df.select(block, F.col(ref).alias(own)).join(met.select(own), own, "left_anti").select(block, own, F.lit(None).cast(df.schema[ref].dataType).alias(other_), F.lit(None).cast(out.schema["distance"].dataType).alias("distance"), F.lit(name).alias("bucket"))
    return out.unionByName(alone(left, "left_ref", "right_ref", "left_only")).unionByName(alone(right, "right_ref", "left_ref", "right_only"))


def worked_off(roots: DataFrame, children: DataFrame, most_depth: int, most_size) -> DataFrame:
    """(item, parent, depth, status) of everything that a queue reaches from the roots, each item once, at its least depth.

    roots: (item, size); children: (parent, item, size). An item larger than ``most_size`` is blocked_size and isn't opened;
    what lies deeper than ``most_depth`` is over_depth. Cycles end, as an item that was met isn't queued again. A level is a join of the last
    level's items and an anti-join with those met before; of several parents on a level the least counts. Levels are written tables.
    """
    children = saved(children)  # every level reads it
    state = F.when(F.col("depth") > most_depth, "over_depth").when(F.col("size") > most_size, "blocked_size").otherwise("processed")
    level = roots.groupBy("item").agg(F.max("size").alias("size")).select("item", F.lit(None).cast(roots.schema["item"].dataType).alias("parent"), F.lit(0).alias("depth"), "size")
    levels = [saved(level.withColumn("status", state))]
    for depth in range(1, most_depth + 2):
        opened = levels[-1].where("status = 'processed'").select(F.col("item").alias("parent"))
        reached = opened.join(children, "parent").groupBy("item").agg(F.min("parent").alias("parent"), F.max("size").alias("size"))
        met = reduce(DataFrame.unionByName, levels).select("item")
        level = saved(reached.join(met, "item", "left_anti").select("item", "parent", F.lit(depth).alias("depth"), "size").withColumn("status", state))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("size")


def stitched(readings: DataFrame, key: str, window: str) -> DataFrame:
    """(key, windows, combinations, best, dead_end) over the ordered windows of each key.

    readings: (key, window, enter, leave, reading). One reading of each window is taken; neighbours fit where one leaves in the
    state that the next enters in. The fold keeps, for each state, the number of fitting prefixes and the least of them, never
    the prefixes themselves, so it is linear in the windows. combinations is 0 and dead_end the first window that nothing fits where there is no way through.
    """
    line = readings.groupBy(key, window).agg(F.array_sort(F.collect_set(F.struct("enter", "leave", "reading"))).alias("ways"))
    line = line.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(window).alias("window"), "ways"))).alias("line"))
    number = "decimal(38,0)"
    total = lambda entries: F.aggregate(entries, F.lit(0).cast(number), lambda t, e: (t + e["n"]).cast(number))
    merged = lambda entries: F.transform(
        F.array_distinct(F.transform(entries, lambda e: e["state"])),
        lambda s: F.struct(s.alias("state"), total(F.filter(entries, lambda e: e["state"] == s)).alias("n"), F.array_min(F.transform(F.filter(entries, lambda e: e["state"] == s), lambda e: e["best"])).alias("best")),
    )
    first = merged(F.transform(F.element_at("line", 1)["ways"], lambda w: F.struct(w["leave"].alias("state"), F.lit(1).cast(number).alias("n"), F.array(w["reading"]).alias("best"))))

    def followed(kept, way):
        fitting = F.filter(kept, lambda e: e["state"] == way["enter"])
        least = F.array_min(F.transform(fitting, lambda e: e["best"]))
        return F.struct(way["leave"].alias("state"), total(fitting).alias("n"), F.concat(least, F.array(way["reading"])).alias("best"))

    def step(kept, window_):
        grown = merged(F.filter(F.transform(window_["ways"], lambda w: followed(kept["entries"], w)), lambda e: e["n"] > 0))
        dead = F.coalesce(kept["dead_end"], F.when(F.size(grown) == 0, window_["window"]))
        return F.struct(grown.alias("entries"), dead.alias("dead_end"))

    kind = readings.schema[window].dataType
    start = F.struct(first.alias("entries"), F.lit(None).cast(kind).alias("dead_end"))
    rest = F.slice("line", 2, 1 << 30)
    folded = line.select(key, F.size("line").alias("windows"), F.aggregate(rest, start, step).alias("end"))
    entries = F.col("end.entries")
    return folded.select(key, "windows", total(entries).alias("combinations"), F.array_min(F.transform(entries, lambda e: e["best"])).alias("best"), "end.dead_end")
