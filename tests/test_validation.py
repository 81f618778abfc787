"""The checks of operators.validation on small rows with nulls, repeats and empty sides."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import validation as C


def one(df):
    return df.collect()[0]["violations"]


def test_orphans_count_rows_and_leave_null_keys(spark):
    child = spark.createDataFrame([(1,), (7,), (7,), (None,)], "k long")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "p long")
    assert one(C.orphans(child, "k", parent, "p", "r")) == 2
    assert one(C.orphans(child, "k", parent.limit(0), "p", "r")) == 3
    assert one(C.orphans(child.limit(0), "k", parent, "p", "r")) == 0


def test_repeated_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a")], "k long, x string")
    assert one(C.repeated(rows, ["k", "x"], "r")) == 2
    assert one(C.repeated(rows.limit(0), ["k"], "r")) == 0


def test_null_checks_fail_and_names_keep_their_order(spark):
    rows = spark.createDataFrame([(1, 3), (5, None), (None, 0)], "a long, b long")
    names = C.failed({"a": F.col("a") < 3, "b": F.col("b") > 1})
    assert [r[0] for r in rows.select(names).collect()] == [[], ["a", "b"], ["a", "b"]]


def test_first_signal_decides(spark):
    rows = spark.createDataFrame([(1,), (20,), (None,)], "a long")
    named = C.first_of([(F.col("a") > 10, "large"), (F.col("a") > 0, "some")], "none")
    assert [r[0] for r in rows.select(named).collect()] == ["some", "large", "none"]


def test_paths(spark):
    rows = spark.createDataFrame([(((2,),), ("x",)), ((None,), None)], "root struct<a: struct<b: int>>, item struct<c: string>")
    assert [tuple(r) for r in rows.select(C.at_path("$root.a.b"), C.at_path("$item.c")).collect()] == [(2, "x"), (None, None)]
    for bad in ("root.a", "$root", "$other.a"):
        with pytest.raises(ValueError):
            C.at_path(bad)


def test_nodes_fold_repeated_attributes(spark):
    events = spark.createDataFrame([(1, "a", "x"), (1, "a", "z"), (1, "b", None), (2, "a", "y")], "k long, name string, value string")
    assert dict(C.nodes(events, "k", "name", "value").collect()) == {1: {"a": "z", "b": None}, 2: {"a": "y"}}
