"""Aggregations: exact sums, consensus, control totals, zero-filled counts, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_equal(*values: Column) -> list[Column]:
    """For each value, the aggregate that it is the same, and not null, in all rows of a group."""
    return [(F.min(v).isNotNull() & F.min(v).eqNullSafe(F.max(v)) & (F.count(v) == F.count("*"))) for v in values]


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, rows) of keys that several rows have."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def control_totals(details: DataFrame, totals: DataFrame, key: str, amounts: dict[str, str]) -> DataFrame:
    """(key, status, difference of each amount): sums of the details against the printed totals. amounts: detail column -> total column."""
    sums = details.groupBy(key).agg(*(F.sum(d).cast("decimal(30,2)").alias(f"sum_{d}") for d in amounts))
    both = totals.join(sums, key, "left")
    gaps = {f"gap_{d}": (F.coalesce(F.col(f"sum_{d}"), F.lit(0)) - F.col(t)).cast("decimal(30,2)") for d, t in amounts.items()}
    status = F.when(F.greatest(*(F.abs(F.col(g)) for g in gaps), F.lit(0)) == 0, "reconciled").otherwise("mismatch")
    return both.select(key, *(v.alias(k) for k, v in gaps.items())).withColumn("status", status)


def zero_filled_counts(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """(column, n) with a row for every level, none left out."""
    dim = df.sparkSession.createDataFrame([(x,) for x in levels], f"{column} string")
    return dim.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").na.fill(0, ["n"])


def member_counts(df: DataFrame, keys: Column, name: str = "key") -> DataFrame:
    """(key, n): rows by the distinct elements of an array column, each row once an element."""
    return df.select(F.explode(F.array_distinct(keys)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def running_budget(df: DataFrame, group: str, order: list[str], cost: str, limit: Column) -> DataFrame:
    """Running sum of the costs of a group, and whether the row is still within the limit."""
    so_far = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", so_far).withColumn("within", F.col("spent") <= limit)


def multiset_overlap(left: DataFrame, right: DataFrame, group: str, token: str) -> DataFrame:
    """(group, common, n_left, n_right) of token multisets: common counts each token as often as both sides have it."""
    count = lambda df, n: df.groupBy(group, token).agg(F.count("*").alias(n))
    both = count(left, "l").join(count(right, "r"), [group, token], "full_outer").na.fill(0, ["l", "r"])
    return both.groupBy(group).agg(F.sum(F.least("l", "r")).alias("common"), F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def union_of_arrays(df: DataFrame, keys: list[str], element: str, contract: str) -> DataFrame:
    """(keys…, elements, conflict): sorted distinct elements of a group; in conflict if its contracts differ."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(element)).alias("elements"), (F.min(contract) != F.max(contract)).alias("conflict"))


def gates(checks: dict[str, Column]) -> list[Column]:
    """passed, and failed: the names of the checks that don't hold, joined."""
    failed = F.concat_ws(",", *(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in sorted(checks.items())))
    return [(failed == "").alias("passed"), failed.alias("failed")]


def ceil_cost(tokens: Column, rate: Column, places: int = 9) -> Column:
    """tokens x rate in exact decimals, rounded up."""
    unit = F.lit(10**places).cast("decimal(20,0)")
    product = tokens.cast("decimal(18,0)") * rate.cast("decimal(12,10)")
    return (F.ceil(product * unit).cast("decimal(28,0)") / unit).cast(f"decimal(28,{places})")
