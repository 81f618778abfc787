"""Checks across and inside collections: references, uniqueness, named conditions, priorities, paths, nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """One row (rule, violations): the rows of ``child`` whose key no ``parent`` has. A null key refers to nothing and is no violation.

    Keys are counted before the join, so a key with many rows is one row in it.
    """
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"))
    lost = keys.join(parent.select(F.col(parent_key).alias("__key")), "__key", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """One row (rule, violations): the keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def all_rules(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def failed(checks: dict[str, Column]) -> Column:
    """The names of the checks that don't hold, in order; a check that is null doesn't hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.lit(None)).otherwise(name) for name, holds in checks.items())))


def first_of(signals: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first signal that holds."""
    return F.coalesce(*(F.when(holds, name) for holds, name in signals), F.lit(otherwise))


def at_path(path: str) -> Column:
    """The value at ``$root.a.b`` or ``$item.a.b`` of rows with the structs root and item."""
    start, _, rest = path.partition(".")
    if start not in ("$root", "$item") or not rest:
        raise ValueError(f"no such path: {path}")
    return F.col(f"{start[1:]}.{rest}")


def nodes(events: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, attributes): the attributes of each element as a map; of a repeated attribute, the greatest value."""
    once = events.groupBy(key, name).agg(F.max(value).alias("__value"))
    return once.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("__value"))))).alias("attributes"))
