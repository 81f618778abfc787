"""Trees, tables of placed words, matching, queues, stitching, blocks, documents, fuzzy fields and PDF text on small tables."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import documents as D
from tallyforge.operators import fuzzy, layout, matching, resolve, trees
from tallyforge.plans.structure import _boxes
from tallyforge.sources import parsers, pdf


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_tree_of_odd_markup(spark):
    deep = "".join(f"<n{i}>" for i in range(30)) + "x" + "".join(f"</n{i}>" for i in reversed(range(30)))
    texts = [(1, "<a><b>x<br>y</b>&lt;z</a>"), (2, "<i><u>cross</i></u>"), (3, "</p><p>open<p>done</p>"), (4, None), (5, ""), (6, "1 < 2"), (7, deep), (8, "<A K=\"q&quot;\"><!-- <b> --><script>if (a<b) </script></A>"), (8, "<c/>")]
    found = trees.nested(spark.createDataFrame(texts[:-1], "id int, html string"), "id", "html").collect()
    own = {i: sorted((r["start"], r["until"], r["depth"], r["parent"], r["path"], r["text"]) for r in found if r["id"] == i) for i in range(1, 9)}
    assert own[1] == [(0, 7, 1, None, "/a", "<z"), (1, 5, 2, 0, "/a/b", "xy"), (3, 3, 3, 1, "/a/b/br", None)]
    assert [r[4] for r in own[2]] == [None, None]
    assert own[3] == [(1, 1, 1, None, "/p", None), (3, 5, 1, None, "/p", "done")]
    assert own[4] == own[5] == own[6] == []
    assert own[7][-1][4] == "/" + "/".join(f"n{i}" for i in range(30)) and own[7][-1][5] == "x" and own[7][-1][3] == 28
    assert [(r["name"], r["text"]) for r in found if r["id"] == 8] == [("a", None)]
    facts = trees.typed_facts(spark.createDataFrame(found, "id int, start int, until int, depth long, parent int, name string, path string, tag string, text string"), "id", [("k", "/a", "k", '^q"$'), ("b", "/b", None, "^[0-9]+$"), ("br", "/br", "id", ".")])
    assert rows(facts, "id", "fact", "value", "status") == [(1, "b", "xy", "invalid"), (1, "br", None, "missing"), (1, "k", None, "missing"), (8, "k", 'q"', "typed")]
    with pytest.raises(ValueError, match="nested"):
        trees.nested(spark.createDataFrame([(7, deep)], "id int, html string"), "id", "html", most_depth=10)


def test_tables_of_words(spark):
    line = lambda page, y, cells, height=8: [(1, page, t, float(x), float(x + 5 * len(t)), float(y), float(y + height)) for x, t in cells]
    words = [
        *line(0, 0, [(0, "day"), (100, "sum"), (200, "note")]), *line(0, 20, [(0, "mon"), (100, "1"), (201, "two"), (220, "words")]), *line(0, 40, [(2, "tue"), (200, "x")]),
        *line(1, 0, [(0, "day"), (100, "sum"), (200, "note")]), *line(1, 20, [(0, "wed"), (100, "3"), (200, "y")]), *line(1, 41, [(0, "thu"), (102, "4"), (200, "z")]),
        *line(3, 0, [(0, "fri"), (100, "5"), (200, "v")]), *line(3, 20, [(0, "sat"), (100, "6"), (200, "w")]), *line(3, 41, [(0, "sun"), (102, "7"), (200, "u")]),
        *line(4, 0, [(0, "plain"), (28, "lines")]), *line(4, 20, [(0, "of"), (12, "prose")]), *line(4, 40, [(0, "only"), (22, "here")]),
    ]
    boxes = spark.createDataFrame(words, "doc int, page int, text string, x0 double, x1 double, y0 double, y1 double")
    found = rows(layout.projected(boxes, "doc", "page", 4, 20), "doc", "table", "row", "lane", "text", "header")
    first = {r[2:5] for r in found if r[1] == 1}
    assert first == {(0, 0, "day"), (0, 1, "sum"), (0, 2, "note"), (1, 0, "mon"), (1, 1, "1"), (1, 2, "two words"), (2, 0, "tue"), (2, 2, "x"), (3, 0, "wed"), (3, 1, "3"), (3, 2, "y"), (4, 0, "thu"), (4, 1, "4"), (4, 2, "z")}
    assert {r[4] for r in found if r[1] == 2 and r[5]} == {"fri", "5", "v"} and {r[1] for r in found} == {1, 2}
    assert layout.projected(boxes.limit(0), "doc", "page", 4, 20).count() == 0


def test_prose_is_no_table(spark):
    found = layout.projected(_boxes(spark, "/root/testdata/sf0.001"), "doc_id", "page", 4, 15)
    tables = found.where("doc_id % 3 = 0").select("doc_id").distinct().count()
    # three or four lines of prose may leave a gap by chance
    assert tables > 40 and found.where("doc_id % 3 <> 0").select("doc_id").distinct().count() <= 4


def greedy(left, right, tolerance):
    pairs = sorted((abs(v - w), v, w, a, b) for k, v, a in left for m, w, b in right if k is not None and k == m and v is not None and w is not None and abs(v - w) <= tolerance)
    used, out = set(), set()
    for d, _, _, a, b in pairs:
        if ("l", a) not in used and ("r", b) not in used:
            used |= {("l", a), ("r", b)}
            out.add((a, b, d, "within_tolerance" if d else "exact"))
    return out | {(a, None, None, "left_only") for _, _, a in left if ("l", a) not in used} | {(None, b, None, "right_only") for _, _, b in right if ("r", b) not in used}


@pytest.mark.parametrize("seed,span", [(0, 12), (1, 60), (2, 400)])
def test_reconciliation_equals_greedy_matching(spark, seed, span):
    rng = random.Random(seed)
    side = lambda n, base: [(rng.choice("ab"), rng.randrange(span), base + i) for i in range(n)] + [(None, 3, base + 900), ("a", None, base + 901)]
    left, right = side(70, 0), side(60, 5000)
    frame = lambda data: spark.createDataFrame(data, "k string, v long, ref long")
    found = matching.reconciled(frame(left), frame(right), "k", "v", "ref", 7)
    assert {tuple(r) for r in found.select("left_ref", "right_ref", "distance", "bucket").collect()} == greedy(left, right, 7)
    assert found.count() == len(greedy(left, right, 7))


def test_reconciliation_of_empty_sides(spark):
    some, none = spark.createDataFrame([("a", 1, 1)], "k string, v long, ref long"), spark.createDataFrame([], "k string, v long, ref long")
    assert [r["bucket"] for r in matching.reconciled(some, none, "k", "v", "ref", 1).collect()] == ["left_only"]
    assert [r["bucket"] for r in matching.reconciled(none, some, "k", "v", "ref", 1).collect()] == ["right_only"]
    assert matching.reconciled(none, none, "k", "v", "ref", 1).count() == 0


def test_queue_of_chains_and_cycles(spark):
    chain = [(i, i + 1, 1) for i in range(15)]
    edges = [*chain, (15, 0, 1), (3, 3, 1), (2, 100, 50), (100, 101, 1), (0, 2, 1), (None, 7, 1), (5, None, 1), (900, 901, 1)]
    found = matching.worked_off(spark.createDataFrame([(0, 1), (0, 1)], "item long, size long"), spark.createDataFrame(edges, "parent long, item long, size long").where("item IS NOT NULL"), 12, 20)
    own = {r["item"]: (r["parent"], r["depth"], r["status"]) for r in found.collect()}
    assert own[0] == (None, 0, "processed") and own[2] == (0, 1, "processed") and own[100] == (2, 2, "blocked_size") and 101 not in own and 901 not in own
    assert own[13] == (12, 12, "processed") and own[14] == (13, 13, "over_depth") and 15 not in own and len(own) == found.count()


def test_stitching_equals_the_product(spark):
    rng, data, wanted = random.Random(4), [], {}
    for key in range(25):
        windows = [sorted({(rng.choice("abc"), rng.choice("abc"), rng.randrange(5)) for _ in range(rng.randrange(1, 4))}) for _ in range(rng.randrange(1, 6))]
        data += [(key, 10 * i, *way) for i, ways in enumerate(windows) for way in ways]
        fits = [p for p in itertools.product(*windows) if all(a[1] == b[0] for a, b in itertools.pairwise(p))]
        far = next((10 * i for i in range(1, len(windows)) if not any(all(a[1] == b[0] for a, b in itertools.pairwise(p)) for p in itertools.product(*windows[: i + 1]))), None)
        wanted[key] = (len(windows), len(fits), min(([w[2] for w in p] for p in fits), default=None), far)
    data += [(99, i, "s", "s", r) for i in range(60) for r in (7, 3)]
    wanted[99] = (60, 2**60, [3] * 60, None)
    found = matching.stitched(spark.createDataFrame(data + data[:9], "k int, w int, enter string, leave string, reading int"), "k", "w")
    assert {r["k"]: (r["windows"], int(r["combinations"]), r["best"], r["dead_end"]) for r in found.collect()} == wanted


def test_spans_through_blocks(spark):
    text = "".join(chr(0x1F600 + i % 40) if i % 7 == 0 else "éa b"[i % 4] for i in range(57))
    index = resolve.blocks(spark.createDataFrame([(1, text, 0), (2, "", 0), (3, None, 0), (4, "x" * 10, 0)], "doc int, text string, block int").drop("block"), "doc", "text", 10)
    spans = [(1, a, b, None) for a in range(0, 58, 3) for b in range(a, 60, 5)] + [(2, 0, 1, None), (3, 0, 1, None), (4, 0, 10, None), (4, -1, 3, None), (9, 0, 1, None), (4, 0, 5, "0" * 64), (None, 0, 1, None)]
    asked = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "span int, doc int, start int, until int, checksum string")
    found = {r["span"]: (r["value"], r["status"]) for r in resolve.resolved(index, asked, "doc", "span", 10).collect()}
    held = {1: text, 2: "", 4: "x" * 10}
    for i, (doc, a, b, checksum) in enumerate(spans):
        if doc not in held:
            assert found[i] == (None, "unknown")
        elif not 0 <= a < b <= len(held[doc]):
            assert found[i] == (None, "out_of_range")
        else:
            assert found[i] == ((None, "changed") if checksum else (held[doc][a:b], "resolved"))


def test_documents_by_definition(spark):
    item = D.Element("item", "items", "id", ("rank", "id"), (D.Field("name", "name", required=True), D.Field("q", "note", attribute=True)), "box", 1, 2)
    box = D.Element("box", "boxes", "box", ("box",), (D.Field("day", "day", "date"),), children=(item,))
    boxes = spark.sql("SELECT box, DATE'2024-03-05' AS day FROM VALUES (1), (2), (3) t(box)")
    items = spark.createDataFrame([(10, 1, 2, "b<&", 'say "x"'), (11, 1, 1, "a", None), (12, 3, 1, None, None), (13, 3, 1, "c", None), (14, 3, 0, "d", None)], "id int, box int, rank int, name string, note string")
    found = {r["box"]: (r["xml"], r["violations"]) for r in D.assembled(box, {"boxes": boxes, "items": items}).collect()}
    assert found[1] == ('<box><day>05.03.2024</day><item><name>a</name></item><item q="say &quot;x&quot;"><name>b&lt;&amp;</name></item></box>', [])
    assert found[2] == ("<box><day>05.03.2024</day></box>", ["/box/item:too_few"])
    assert found[3] == ("<box><day>05.03.2024</day><item><name>d</name></item><item></item><item><name>c</name></item></box>", ["/box/item/name:missing", "/box/item:too_many"])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_fuzzy_pairs_equal_all_pairs(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 2, 3, 5, 7, 9, 11, 14])))
    left = [word() for _ in range(50)]
    right = [w[: len(w) // 2] + rng.choice(["", "a", "bb"]) + w[len(w) // 2 + rng.randrange(2) :] for w in left] + [word() for _ in range(30)]
    frame = lambda data, name: spark.createDataFrame([(x,) for x in [*data, None, data[0]]], f"{name} string")
    found = fuzzy.within_distance(frame(left, "x"), frame(right, "y"), "x", "y", k)
    assert {tuple(r) for r in found.collect()} == {(a, b, edits(a, b)) for a in left for b in right if edits(a, b) <= k}


def test_pdf_operators():
    stream = b"BT /F1 9 Tf 10 TL 1 0 0 1 5 5 Tm (A \\(nested (deep)\\) \\101\\n) Tj 0 -10 Td [(wi) -20 (de) -300 (gap)] TJ T* <48 65 6C6C6> Tj (same) Tj (next) ' % (no) Tj\n2 3 (third) \" 5 0 Td (still) Tj ET q /Im1 Do Q BT <FEFF0416> Tj (line\\\nfold) Tj ET"
    assert list(pdf.shown_lines(stream)) == ["A (nested (deep)) A\n", "wide gap", "Hell`same", "next", "thirdstill", "Жlinefold"]
    assert list(pdf.shown_lines(b"")) == []
    with pytest.raises(ValueError, match="no end"):
        list(pdf.shown_lines(b"(never"))


def test_contents_share_frames():
    import pandas as pd

    files = pd.DataFrame({"id": range(300), "content": [pdf.pdf_bytes(f"{i}\nend") if i % 7 else b"plain" for i in range(300)]})
    decode, columns = parsers.FORMATS["pdf"]
    found = list(parsers.rows_of(decode, [c.split()[0] for c in columns.split(", ")])(iter([files[:100], files[100:]])))
    assert len(found) == 1  # one for each file before
    rows = [tuple(None if x is None else x for x in r) for r in found[0].itertuples(index=False)]
    assert rows == [r for i in range(300) for r in ([(i, 0, 0, str(i), None), (i, 0, 1, "end", None)] if i % 7 else [(i, None, None, None, "damaged")])]


def test_pdf_files(spark):
    long = "\n".join(f"Zeile {i} \\ ( ) ж" if i % 3 else "" for i in range(95))
    files = {1: pdf.pdf_bytes(long), 2: pdf.pdf_bytes(""), 3: pdf.pdf_bytes(long).rpartition(b"endstream")[0][:-5], 4: b"plain", 5: b"%PDF-1.4 /Encrypt", 6: None, 7: b"%PDF-1.4\n<< /Length 9 >>\nstream\n(raw) Tj \nendstream\n<< /Type /XObject /Subtype /Image >>\nstream\n(no) Tj\nendstream"}
    files[8] = b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"(cut) Tj")[:-5] + b"\nendstream"
    found = parsers.read_as(spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in files.items()], "id int, content binary"), "pdf").collect()
    assert "\n".join(r["text"] for r in sorted((r for r in found if r["id"] == 1), key=lambda r: (r["page"], r["line"]))) == long
    assert {r["page"] for r in found if r["id"] == 1} == {0, 1, 2}
    assert {r["id"]: r["error"] for r in found if r["error"]} == {2: "no_rows", 3: "damaged", 4: "damaged", 5: "damaged", 6: "unavailable", 8: "damaged"}
    assert [r["text"] for r in found if r["id"] == 7] == ["raw"]


def test_typed_facts_need_paths(spark):
    nodes = spark.createDataFrame([(1, 0, None, "<a>", "x")], "id int, start int, path string, tag string, text string")
    assert trees.typed_facts(nodes, "id", [("f", "/a", None, ".")]).count() == 0
    assert nodes.select(trees.attribute(F.lit("<a Href=\"x\" b='y'>"), "href")).first()[0] == "x"


def test_edges_of_a_queue_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(5)], "parent long, item long, size long").coalesce(1)
    roots = spark.createDataFrame([(0, 1)], "item long, size long")
    found = matching.worked_off(roots, chain.withColumn("size", F.udf(count, "long")("size")), 9, 5)
    assert found.count() == 6 and seen.value == 5
