"""Tables of placed words: what is shuffled for them, and odd documents, boxes and cells."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import layout
from tallyforge.plans.registry import ORACLES, QUERIES
from tallyforge.plans.structure import _boxes

DATA = "/root/testdata/sf0.001"
CELLS = 'doc_id, "table", "row", lane, text, header'


def shuffled(spark):
    """Records written to shuffles in this session so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_words_are_not_shuffled_one_by_one(spark):
    words = _boxes(spark, DATA).count()
    before = shuffled(spark)
    assert QUERIES["table_projection"](spark, DATA).count() > 0
    assert shuffled(spark) - before < words / 10  # a row a document and a row a page; before: every word, twice


def test_odd_documents_equal_the_sql(spark, tmp_path):
    lines = lambda *ns: " ".join(f"w{n}" for n in ns)
    head = "day sum note kind"
    docs = [
        (3, lines(*range(400))), (3, head), (3, lines(*range(90))),  # one doc_id, three texts: they share pages, and the second text's line is repeated with theirs
        (6, f"{head} {lines(*range(304))}"), (9, " ".join([head] * 60)), (12, "one"), (15, ""), (18, " \n "), (21, None), (None, lines(*range(200))), (None, None),
        (4, lines(*range(500))), (4, lines(*range(181))), (7, " ".join("abcdefghij"[: 1 + n % 9] * 5 for n in range(400))), (-3, lines(*range(77))), (-2, lines(*range(30))), (24, lines(*range(76))), (27, lines(*range(80))), (30, lines(*range(81))), (10, ""),
        (33, "ä b\tc  ü\n\nx " * 60),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["table_projection"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.sql(f"SELECT {CELLS} FROM ({ORACLES['table_projection']})").fetchall()
    assert sorted(tuple(r) for r in found.selectExpr("doc_id", "`table`", "`row`", "lane", "text", "header").collect()) == sorted(wanted)
    assert {3, 6, 9} <= {r[0] for r in wanted}


def bands(spans, gap):
    """The band of every (low, high), by their order."""
    out, reach, band = {}, None, 0
    for k in sorted(range(len(spans)), key=lambda k: (spans[k][0], spans[k][1])):
        band += reach is not None and spans[k][0] - reach > gap
        reach = max(spans[k][1], reach if reach is not None else spans[k][1])
        out[k] = band
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cells_equal_a_plain_sweep(spark, seed):
    rng, words = random.Random(seed), []
    for page in range(700):  # more than are laid out at once
        for _ in range(rng.choice([1, 2, 5, 12, 40])):
            x, y = rng.randrange(0, 60), rng.randrange(0, 60)
            words.append((page, rng.choice(["a", "b", "", "ü", None, "long one"]), x, x + rng.randrange(0, 9), y, float(y + rng.randrange(0, 5))))
    wanted = {}
    for page in range(700):
        own = [w[1:] for w in words if w[0] == page]
        band, lane = bands([w[3:5] for w in own], 2), bands([w[1:3] for w in own], 1)
        held = {}
        for k, w in enumerate(own):
            held.setdefault((band[k], lane[k]), []).append((w[3], w[1], w[2], w[0] is not None, w[0] or ""))
        filled = [sum(b == n for n, _ in held) for b in range(max(band.values()) + 1)]
        texts = [" ".join(w[4] for w in sorted(held[k]) if w[3]) for k in sorted(held)]
        wanted[page] = (len(filled), max(lane.values()) + 1, sum(n >= 2 for n in filled), filled[0], [b for b, _ in sorted(held)], [n for _, n in sorted(held)], texts)
    pages = layout.paged(spark.createDataFrame(words, "page int, text string, x0 int, x1 int, y0 long, y1 double"), ["page"])
    found = {r[0]: tuple(r)[1:] for r in layout.cells(pages, ["page"], 2, 1).collect()}
    assert found == wanted


def test_pages_without_words_or_places(spark):
    pages = spark.createDataFrame([(1, []), (2, None), (3, [("a", 0.0, 4.0, 0.0, 1.0), ("b", None, None, None, None), ("c", 90.0, 95.0, 0.0, 1.0)])], "page int, words array<struct<text string, x0 double, x1 double, y0 double, y1 double>>")
    found = {r["page"]: (r["bands"], r["lanes"], r["text"]) for r in layout.cells(pages, ["page"], 2, 5).collect()}
    assert found == {1: (0, 0, []), 2: (0, 0, []), 3: (1, 2, ["b a", "c"])}
    assert layout.projected_pages(pages.withColumn("doc", F.lit(1)), "doc", "page", 2, 5).count() == 0
