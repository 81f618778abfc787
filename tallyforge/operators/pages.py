"""Paging, freshness guards, references, coverage of multisets, and facts from neighbouring cells."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(rows: DataFrame, key: str, after, size: int, scope: str) -> DataFrame:
    """The ``size`` rows that follow the key ``after`` (None: from the start), each with the key that the next page begins after and its token, a digest of scope and key."""
    page = (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)
    last = F.max(key).over(Window.partitionBy())  # of a page, which is bounded
    return page.withColumns({"next_after": last, "continuation": F.sha2(F.concat_ws("|", F.lit(scope), last.cast("string")), 256)})


def resumed_page(rows: DataFrame, key: str, after, token: str, size: int, scope: str) -> DataFrame:
    """The page behind ``after``, if the token is that of this scope and key; a token of another query or key is an error."""
    if hashlib.sha256(f"{scope}|{after}".encode()).hexdigest() != token:
        raise ValueError("the token doesn't continue this query")
    return keyset_page(rows, key, after, size, scope)


def fresh_only(rows: DataFrame, bound: DataFrame, upstream: DataFrame, key: str, version: str) -> DataFrame:
    """``rows`` with status: fresh where the version that they were built from is still the upstream one, else stale, missing without one."""
    both = bound.select(key, F.col(version).alias("__bound")).join(upstream.select(key, F.col(version).alias("__now")), key, "left")
    state = F.when(F.col("__now").isNull(), "missing").when(F.col("__bound") == F.col("__now"), "fresh").otherwise("stale")
    return rows.join(both.select(key, state.alias("status")), key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def multiset_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, missing, extra): how often the right side lacks a key of the left one, or has it beyond that; only differences."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(left, "__l").join(count(right, "__r"), key, "full").fillna(0, ["__l", "__r"])
    missing, extra = F.greatest(F.col("__l") - F.col("__r"), F.lit(0)), F.greatest(F.col("__r") - F.col("__l"), F.lit(0))
    return both.where("__l <> __r").select(key, missing.alias("missing"), extra.alias("extra"))


def adjacent_facts(cells: DataFrame, row: list[str], col: str, literal: str) -> DataFrame:
    """(row, label, value): rows of exactly two cells, in two columns, the first a label."""
    two = cells.groupBy(*row).agg(F.count("*").alias("__n"), F.min_by(literal, col).alias("label"), F.max_by(literal, col).alias("value"), F.min(col).alias("__a"), F.max(col).alias("__b"))
    return two.where("__n = 2 AND __a < __b").select(*row, "label", "value")


def column_facts(cells: DataFrame, table: str, row: str, col: str, literal: str, is_header: Column) -> DataFrame:
    """(table, row, col, literal): the cells below a header in its column. A header stands in its table's first row; a column with any
    cell twice is left out, and so is a table in which several columns have the header."""
    first = cells.groupBy(table).agg(F.min(row).alias("__first"))
    twice = cells.groupBy(table, row, col).count().where("count > 1").select(table, col).distinct()
    headers = cells.join(first, table).where((F.col(row) == F.col("__first")) & is_header).join(twice, [table, col], "left_anti").select(table, col, "__first")
    alone = headers.groupBy(table).agg(F.count("*").alias("__n"), F.first(col).alias(col), F.first("__first").alias("__first")).where("__n = 1")
    return cells.join(alone.select(table, col, "__first"), [table, col]).where(F.col(row) > F.col("__first")).select(table, row, col, literal)
