"""Packages, batches, chains, activation, arbitration and accounting on small tables."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.operators import persistence as K
from tallyforge.sources import office, parsers


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_package_is_sealed_once(spark, tmp_path):
    table = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "doc string, n int, v string")
    index = {}
    for order in ((0, 1), (1, 0)):
        parts = (table.where("n = 1"), table.where("n = 2"))
        package = K.Package(spark, f"{tmp_path}/{order[0]}", "doc", "n")
        with pytest.raises(ValueError, match="isn't sealed"):
            package.read()
        for i in order:
            package.append(parts[i])
        index[order] = rows(package.seal(), "doc", "records", "first", "last", "checksum")
        assert rows(package.read(), "doc", "n", "v") == rows(table, "doc", "n", "v")
        assert rows(package.read(spark.createDataFrame([("b",), ("b",), ("z",)], "doc string")), "doc") == [("b",)]
        for late in (lambda p=package: p.append(table), lambda p=package: p.seal()):
            with pytest.raises(ValueError, match="sealed"):
                late()
    assert index[0, 1] == index[1, 0] and [r[:4] for r in index[0, 1]] == [("a", 2, 1, 2), ("b", 1, 1, 1)]


def test_batch_states(spark):
    state = lambda data: K.batch_status(spark.createDataFrame(data, "k int, s string"), "k", "s").first()
    assert state([(1, "done"), (2, "failed"), (3, "done")]).asDict() | {"checksum": 0} == {"records": 3, "repeated": 0, "counts": "done:2,failed:1", "overall": "partial", "checksum": 0}
    assert state([(1, "done"), (1, "done")])["overall"] == "invalid" and state([(1, "failed")])["overall"] == "failed" and state([(1, "failed"), (2, "pending")])["overall"] == "pending"
    assert state([])["overall"] == "complete" and state([])["records"] == 0
    assert state([(1, "a"), (2, "b")])["checksum"] == state([(2, "b"), (1, "a")])["checksum"] != state([(1, "b"), (2, "a")])["checksum"]


def test_chains_with_cycles_and_gaps(spark):
    puts = spark.createDataFrame([(i, 1, False) for i in range(7)] + [(4, 2, True), (5, 2, True), (5, 3, None)], "k int, v int, deleted boolean")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (4, 6), (3, 5), (5, 6), (9, 6), (3, 5)], "parent int, child int")
    found = rows(K.chains(K.latest(puts, "k", ["v"]), edges, "k"), "k", "ancestor", "depth")
    assert found == [(0, 0, 3), (0, 1, 2), (0, 2, 1), (1, 0, 1), (1, 1, 3), (1, 2, 2), (2, 0, 2), (2, 1, 1), (2, 2, 3), (5, 3, 1), (6, 3, 2), (6, 5, 1)]
    with pytest.raises(ValueError, match="longer"):
        K.chains(puts.where("v = 1"), edges, "k", most_depth=1)


def test_activation_compares_and_sets(spark):
    versions = spark.createDataFrame([(k, v, s) for k in range(6) for v, s in ((1, "active" if k else "validated"), (2, "validated"), (3, "candidate"), (4, "superseded"))], "k int, version int, state string")
    asked = spark.createDataFrame([(0, 2, None), (1, 2, 1), (2, 2, 3), (3, 3, 1), (4, 4, 1), (4, 2, 1), (5, 4, 1), (9, 1, None)], "k int, version int, expected int")
    found = {(r["k"], r["version"]): (r["state"], r["outcome"]) for r in K.activated(versions, asked, "k").collect()}
    assert found[0, 2] == ("active", "applied") and found[1, 1] == ("superseded", "applied") and found[1, 2] == ("active", "applied")
    assert found[2, 1] == ("active", "stale") and found[3, 1] == ("active", "not_ready") and found[4, 1] == ("active", "contested") and found[5, 4] == ("active", "applied")
    assert all(sum(s == "active" for (k, _), (s, _) in found.items() if k == own) <= 1 for own in range(6))


def test_arbitration_takes_the_least_rule(spark):
    signal = lambda data: spark.createDataFrame(data, "k int, signal string")
    rules = spark.createDataFrame([(3, "c", None, None), (2, "b", "x", None), (1, "a", "x", "absent")], "rule int, status string, one string, two string")
    found = K.arbitrated({"one": signal([(1, "x"), (2, "x"), (3, "x"), (3, "y")]), "two": signal([(2, "q"), (4, "q")])}, "k", rules)
    assert rows(found, "k", "status", "rule") == [(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "c", 3)]
    assert rows(K.arbitrated({"one": signal([(1, "z")]), "two": signal([])}, "k", rules.where("rule < 3")), "k", "status") == [(1, "undecided")]


def test_lookup_accounting_and_demands(spark):
    f = spark.createDataFrame
    assert rows(K.looked_up(f([(1,), (2,), (None,)], "k int"), f([(2, "r"), (3, "r")], "k int, v string"), "k"), "k", "status") == [(1, "missing"), (2, "found"), (3, "unobserved"), (None, "missing")]
    cells, sent = f([(1, 1, "a"), (1, 2, None), (2, 1, "c"), (2, 2, "d")], "r int, c int, v string"), f([(1, 1, "a"), (1, 2, None), (2, 1, "x"), (3, 3, "z"), (1, 1, "a")], "r int, c int, v string")
    assert rows(K.accounted(cells, sent, ["r", "c"], "v"), "r", "c", "status") == [(1, 1, "repeated"), (1, 2, "same"), (2, 1, "changed"), (2, 2, "missing"), (3, 3, "unknown")]
    demands, facts = f([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "k int, kind string"), f([(1, "x", 5), (1, "x", 1), (2, "x", None), (3, "y", 9)], "k int, kind string, n int")
    assert rows(K.demand_metrics(demands, facts, "k", "kind", lambda: F.col("n") > 2), "kind", "demands", "satisfied", "unusable", "wrong_kind", "no_fact") == [("x", 3, 1, 1, 1, 0), ("y", 1, 0, 0, 0, 1)]


def test_rejections_agree_with_values(spark):
    cases = [("date", "01.02.2024"), ("date", "31.02.2024"), ("date", "soon"), ("amount", "1.234,5"), ("amount", "12 34"), ("amount", "x"), ("currency", "eur"), ("currency", "euro"), ("note", "ok"), ("note", " "), ("note", None), ("quantity", "")]
    table = spark.createDataFrame(cases, "role string, x string")
    found = table.select("role", "x", V.role_rejection(F.col("role"), F.col("x"), "dot_comma").alias("why"), V.role_value(F.col("role"), F.col("x"), "dot_comma")["value"].alias("v")).collect()
    assert all((r["why"] is None) == (r["v"] is not None) for r in found)
    assert {(r["role"], r["x"]): r["why"] for r in found if r["why"]} == {("date", "31.02.2024"): "no_such_day", ("date", "soon"): "not_a_date", ("amount", "x"): "not_a_number", ("currency", "euro"): "not_a_code", ("note", " "): "blank", ("note", None): "missing", ("quantity", ""): "blank"}


def test_office_files_round_trip(spark):
    books = spark.createDataFrame([(1, [["a<b", "=A1"], ["a<b", "é"]])], "id int, rows array<array<string>>")
    cells = parsers.read_as(office.written(books, "id", "rows", office.workbook), "xlsx")
    assert rows(cells, "cell", "text", "is_formula") == [("A1", "a<b", False), ("A2", "a<b", False), ("B1", None, True), ("B2", "é", False)]
    texts = spark.createDataFrame([(1, ["# T & t", "", "body"])], "id int, lines array<string>")
    assert rows(parsers.read_as(office.written(texts, "id", "lines", office.document), "docx"), "ordinal", "style", "text") == [(0, "Heading1", "T & t"), (1, None, "body")]


@pytest.mark.parametrize("edges, wanted", [
    ([(1, 2), (2, 3), (3, 4), (9, 8)], {(2, 1, 1), (3, 2, 1), (3, 1, 2), (4, 3, 1), (4, 2, 2), (4, 1, 3)}),
    ([(1, 2), (2, 3), (3, 1), (3, 4)], {(2, 1, 1), (3, 2, 1), (1, 3, 1), (4, 3, 1), (2, 3, 2), (3, 1, 2), (1, 2, 2), (4, 2, 2), (2, 2, 3), (3, 3, 3), (1, 1, 3), (4, 1, 3)}),
    ([(1, 2), (1, 3), (2, 4), (3, 4), (1, 4)], {(2, 1, 1), (3, 1, 1), (4, 2, 1), (4, 3, 1), (4, 1, 1)}),
])
def test_chains_are_written_once(spark, monkeypatch, edges, wanted):
    from tallyforge.operators import persistence

    written = []

    def counted(df, saved=persistence.saved):
        written.append((out := saved(df)).count())
        return out

    monkeypatch.setattr(persistence, "saved", counted)
    there = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "a long")
    found = persistence.chains(there, spark.createDataFrame(edges, "parent long, child long"), "a", 6)
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)
    if len(edges) == 4 and (9, 8) in edges:
        assert sum(written) == 3 + 3  # the edges and the further levels
