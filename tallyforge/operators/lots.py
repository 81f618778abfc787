"""Cost of disposals from lots taken first in, first out, and the state of each group of lots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import basis_gaps, fifo_matches


def priced_matches(rows: DataFrame, group: str, order: list[str], is_buy: Column, quantity: str, ref: str, cents: str) -> DataFrame:
    """(group, buy_ref, sell_ref, matched, buy_quantity, cost): matches with the share of the buy's cost in whole cents.

    A share is the difference of two rounded-down parts, up to the match's end and up to its start, so the shares of a buy that is used up add up to its cost.
    """
    matches = fifo_matches(rows, group, order, is_buy, quantity, ref)
    buys = rows.where(is_buy).select(group, F.col(ref).alias("buy_ref"), F.col(quantity).alias("buy_quantity"), F.col(cents).alias("__cents"))
    part = lambda taken: F.expr(f"CAST({taken} AS DECIMAL(38,0)) * __cents div CAST(buy_quantity AS DECIMAL(38,0))")
    share = part("(buy_quantity - rest)") - part("(buy_quantity - rest - matched)")
    return matches.join(buys, [group, "buy_ref"]).select(group, "buy_ref", "sell_ref", "matched", "buy_quantity", share.cast("long").alias("cost"))


def disposal_costs(rows: DataFrame, group: str, order: list[str], is_buy: Column, quantity: str, ref: str, cents: str) -> DataFrame:
    """(group, sell_ref, matched, cost, lots, status) of every sell: covered, partial, or uncovered, which has no cost rather than a zero."""
    sums = priced_matches(rows, group, order, is_buy, quantity, ref, cents).groupBy(group, "sell_ref").agg(F.sum("matched").alias("matched"), F.sum("cost").alias("cost"), F.count("*").alias("lots"))
    sells = rows.where(~is_buy).select(group, F.col(ref).alias("sell_ref"), F.col(quantity).alias("sold"))
    out = sells.join(sums, [group, "sell_ref"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    status = F.when(F.col("matched") == F.col("sold"), "covered").when(F.col("matched") > 0, "partial").otherwise("uncovered")
    return out.select(group, "sell_ref", F.col("matched").cast("long").alias("matched"), "cost", F.coalesce("lots", F.lit(0)).alias("lots"), status.alias("status"))


def ambiguous_days(rows: DataFrame, group: str, day: str, is_buy: Column, quantity: str, ref: str, cents: str) -> DataFrame:
    """(group, day): buys of one day at different unit costs that sells consume in part, so that their order would decide the cost."""
    taken = fifo_matches(rows, group, [day], is_buy, quantity, ref).groupBy(group, "buy_ref").agg(F.sum("matched").alias("taken"))
    buys = rows.where(is_buy).select(group, day, F.col(ref).alias("buy_ref"), quantity, F.col(cents).alias("__cents"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    first = lambda c: F.first(exact(c)).over(Window.partitionBy(group, day).orderBy("buy_ref"))
    buys = buys.withColumn("other", exact("__cents") * first(quantity) != first("__cents") * exact(quantity))  # unit costs, by cross products
    days = buys.join(taken, [group, "buy_ref"], "left").groupBy(group, day).agg(F.bool_or("other").alias("several"), F.sum(quantity).alias("bought"), F.coalesce(F.sum("taken"), F.lit(0)).alias("taken"))
    return days.where("several AND taken > 0 AND taken < bought").select(group, day)


def group_states(rows: DataFrame, group: str, day: str, is_buy: Column, quantity: str, ref: str, cents: str) -> DataFrame:
    """(group, state) of every group: one that fails doesn't take others with it, one without sells isn't activated."""
    gaps = basis_gaps(rows, group, is_buy, quantity)
    doubt = ambiguous_days(rows, group, day, is_buy, quantity, ref, cents).select(group).distinct().withColumn("doubt", F.lit(True))
    state = F.when(F.col("sold") == 0, "inactive").when(F.col("uncovered") > 0, "short").when(F.col("doubt"), "ambiguous").otherwise("ready")
    return gaps.join(doubt, group, "left").select(group, state.alias("state"))


def same_row(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equality join on keys that are unique on both sides: a charge belongs to the row it stands in, or to none."""
    alone = lambda df: df.join(df.groupBy(*keys).count().where("count = 1").select(*keys), keys, "left_semi")
    return alone(left).join(alone(right), keys)
