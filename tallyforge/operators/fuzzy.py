"""Edit-distance join of short texts: candidates share a rare gram near the same place, or a form with letters left out; all are verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 2


def _shortened(x: Column) -> Column:
    """A text and all that is left of it without one of its letters."""
    n = F.char_length(x)
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, n)))
    return F.array_distinct(F.concat(F.array(x), F.when(n > 0, without).otherwise(F.array().cast("array<string>"))))


def _left_out(x: Column, k: int) -> Column:
    forms = F.array(x)
    for _ in range(k):
        forms = F.array_distinct(F.flatten(F.transform(forms, _shortened)))
    return forms


def _rare_grams(texts: DataFrame, side: str, frequency: DataFrame, k: int) -> DataFrame:
    """The Q * k + 1 rarest grams of each text with their places: two texts within k edits share one of them."""
    grams = _grams(texts, side).join(frequency, "gram").groupBy(side).agg(F.array_sort(F.collect_list(F.struct("n", "gram", "place"))).alias("grams"))
    kept = grams.select(side, F.char_length(side).alias("size"), F.explode(F.slice("grams", 1, Q * k + 1)).alias("g"))
    return kept.select(side, "size", F.col("g.gram").alias("gram"), F.col("g.place").alias(f"{side}_place"))


def _grams(texts: DataFrame, side: str) -> DataFrame:
    places = F.sequence(F.lit(1), F.char_length(side) - (Q - 1))
    return texts.select(side, F.explode(places).alias("place")).select(side, "place", F.substring(F.col(side), F.col("place"), F.lit(Q)).alias("gram"))


def within_distance(left: DataFrame, right: DataFrame, left_col: str, right_col: str, k: int) -> DataFrame:
    """(left, right, distance): all pairs of distinct texts at most ``k`` edits apart. Nulls match nothing.

    Longer texts: of texts within k edits, the rarest Q * k + 1 grams share one, at places at most k apart; candidates also have lengths
    at most k apart, which is part of the join's key, so a common gram is spread by length. Texts with too few grams for that meet by the forms that are left when up to
    k letters are left out. Grams are counted over both sides first.
    """
    a = left.select(F.col(left_col).alias("a")).where("a IS NOT NULL").distinct()
    b = right.select(F.col(right_col).alias("b")).where("b IS NOT NULL").distinct()
    least = Q * k + Q
    long = lambda df, side: df.where(F.char_length(side) >= least)
    short = lambda df, side: df.where(F.char_length(side) < least + k)
    frequency = _grams(long(a, "a"), "a").select("gram").unionAll(_grams(long(b, "b"), "b").select("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    spread = _rare_grams(long(a, "a"), "a", frequency, k).withColumn("size", F.explode(F.sequence(F.col("size") - k, F.col("size") + k)))
    by_gram = spread.join(_rare_grams(long(b, "b"), "b", frequency, k), ["gram", "size"]).where(F.abs(F.col("a_place") - F.col("b_place")) <= k).select("a", "b")
    form = lambda df, side: short(df, side).select(side, F.explode(_left_out(F.col(side), k)).alias("form"))
    by_form = form(a, "a").join(form(b, "b"), "form").select("a", "b")
    met = by_gram.unionByName(by_form).distinct().withColumn("distance", F.levenshtein("a", "b", k)).where("distance >= 0")
    return met.select(F.col("a").alias(left_col), F.col("b").alias(right_col), "distance")
