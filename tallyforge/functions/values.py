"""Values of roles: normalizers that name the transform they applied, reproduction of normalized values, header rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _normalized(value: Column, transform: str) -> Column:
    """struct(value, transform); without a value there is no transform either."""
    return F.struct(value.alias("value"), F.when(value.isNotNull(), F.lit(transform)).alias("transform"))


def as_date(x: Column) -> Column:
    """The date that a literal begins with, day first with dots or year first with dashes; null for others."""
    head = F.substring(F.trim(x), 1, 10)
    return F.coalesce(F.try_to_timestamp(F.when(head.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), head), F.lit("dd.MM.yyyy")), F.try_to_timestamp(F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head), F.lit("yyyy-MM-dd"))).cast("date")


def as_decimal(x: Column, convention: str) -> Column:
    """A decimal by its column's convention: comma_dot (1,234.50), dot_comma (1.234,50) or plain; groups have to have three digits."""
    group, point = {"comma_dot": (",", r"\."), "dot_comma": (r"\.", ","), "plain": ("(?!)", r"[.,]")}[convention]
    bare = F.regexp_replace(F.trim(x), "[  ]", "")
    fits = bare.rlike(rf"^[-+]?(\d{{1,3}}({group}\d{{3}})+|\d+)({point}\d+)?$")
    return F.when(fits, F.regexp_replace(F.regexp_replace(bare, group, ""), point, ".").cast("decimal(30,6)"))


def role_value(role: Column, x: Column, convention: str = "plain") -> Column:
    """struct(value, transform) by role: dates, amounts and quantities, currencies; text for any other role. Null where the literal isn't one."""
    day, number, code = F.date_format(as_date(x), "yyyy-MM-dd"), as_decimal(x, convention), F.upper(F.trim(x))
    return (
        F.when(role == "date", _normalized(day, "date_prefix"))
        .when(role.isin("amount", "quantity"), _normalized(number.cast("decimal(30,2)").cast("string"), f"decimal_{convention}"))
        .when(role == "currency", _normalized(F.when(code.rlike("^[A-Z]{3}$"), code), "currency_upper"))
        .otherwise(_normalized(F.nullif(F.trim(x), F.lit("")), "text_trim"))
    )


def role_rejection(role: Column, x: Column, convention: str = "plain") -> Column:
    """Why a literal is no value of its role; null where it is one. missing and blank come before what the role asks for."""
    bare = F.trim(x)
    dated = F.substring(bare, 1, 10).rlike(r"^(\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2})$")
    return (
        F.when(x.isNull(), "missing").when(bare == "", "blank")
        .when((role == "date") & as_date(x).isNull(), F.when(dated, "no_such_day").otherwise("not_a_date"))
        .when(role.isin("amount", "quantity") & as_decimal(x, convention).isNull(), F.when(bare.rlike(r"^[-+]?[0-9][0-9., ]*$"), "grouping").otherwise("not_a_number"))
        .when((role == "currency") & ~F.upper(bare).rlike("^[A-Z]{3}$"), "not_a_code")
    )


def reproduced(kind: Column, literal: Column) -> Column:
    """The value that a mechanical rule gives for a literal, or null where the rule doesn't apply to it."""
    bare = F.trim(literal)
    return (
        F.when(kind == "trimmed_text", F.nullif(bare, F.lit("")))
        .when((kind == "decimal_dot") & bare.rlike(r"^-?\d+([.,]\d+)?$"), F.replace(bare, F.lit(","), F.lit(".")))
        .when((kind == "iso_date_exact") & as_date(bare).isNotNull() & bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), bare)
        .when((kind == "currency_visible") & bare.rlike("^[A-Za-z]{3}$"), F.upper(bare))
    )


def looks_like_header(cells: Column) -> Column:
    """At least one cell with a letter, and none that is a number."""
    return F.exists(cells, lambda c: c.rlike(r"\p{L}")) & ~F.exists(cells, lambda c: F.trim(c).rlike(r"^[-+]?\d+([.,]\d+)?$"))


def sequence_distance(left: Column, right: Column) -> Column:
    """Edit distance of two arrays of tokens: each token stands as one character, numbered by its place among the tokens of both (a million at most)."""
    tokens = F.array_distinct(F.concat(left, right))
    # code points from U+10000 on: beyond the surrogates, one character a token
    coded = lambda side: F.array_join(F.transform(side, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(tokens, t) + 0xFFFF), 8, "0")), "UTF-32")), "")
    return F.levenshtein(coded(left), coded(right))


def common_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings, null if either is: the dynamic program's rows, each a running maximum."""

    @F.pandas_udf("int")
    def of(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _common(a, b) for a, b in zip(lefts, rights, strict=True)], dtype="Int32")

    return of(left, right)


def _common(a, b) -> int:
    places = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    other = np.array([places[t] for t in b], np.int64)
    row = np.zeros(len(other) + 1, np.int32)
    for t in a:
        row[1:] = np.maximum.accumulate(np.where(other == places[t], row[:-1] + 1, row[1:]))
    return int(row[-1])
