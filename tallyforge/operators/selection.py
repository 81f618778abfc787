"""Filters, paging, semi-joins and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, **wanted) -> DataFrame:
    """Rows that satisfy all given conditions: a value (equality), a list (membership) or a (low, high) pair
    (closed range); None sets no condition. Nulls never match."""
    for name, value in wanted.items():
        if isinstance(value, tuple):
            df = df.where(F.col(name).between(*value))
        elif isinstance(value, list):
            df = df.where(F.col(name).isin(value))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df


def normalized_filter(text: str | None, fold: bool = False) -> str | None:
    """A filter value as it is compared: spaces collapsed and trimmed, lower or upper case."""
    if text is None or not text.split():
        return None
    joined = " ".join(text.split())
    return joined.casefold() if fold else joined.upper()


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page by a total order. Spark keeps offset + limit rows a task, and never sorts the rest."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit has to be from 1 to {most}")
    return df.orderBy(*order).offset(offset).limit(limit)


def without_stale(df: DataFrame, expired: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the expired ones."""
    return df.join(expired.select(key), key, "left_anti")


def access_error(df: DataFrame, checks: list[tuple[Column, str]], out: str = "error") -> DataFrame:
    """The code of the first check that fails, else null."""
    verdict = F.lit(None).cast("string")
    for fails, code in reversed(checks):
        verdict = F.when(fails, code).otherwise(verdict)
    return df.withColumn(out, verdict)


def role_values(roles: Column, names: list[str]) -> dict[str, Column]:
    """Values of an array of (role, status, value) structs by role; null where a role has none."""

    def value_of(name: str) -> Column:
        return F.get(F.filter(roles, lambda r: (r["role"] == name) & (r["status"] == "value")), 0)["value"]

    return {n: value_of(n) for n in names}


def missing_roles(roles: Column, names: list[str]) -> Column:
    present = F.transform(F.filter(roles, lambda r: r["status"] == "value"), lambda r: r["role"])
    return F.array_except(F.array(*map(F.lit, names)), present)
