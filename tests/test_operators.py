"""Operators on small tables: cases that the driver tables don't hold."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import literals as L
from tallyforge.functions import values as V
from tallyforge.operators import aggregates as A
from tallyforge.operators import joins as J
from tallyforge.operators import lots as P
from tallyforge.operators import pages
from tallyforge.operators import selection as S
from tallyforge.operators import sequences as Q
from tallyforge.sources import containers, parsers, store, transcripts
from tallyforge.streaming import events as stream


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def fifo_by_hand(lots):
    out, buys = {}, [[ref, q] for ref, side, q in lots if side == "B" and q > 0]
    for ref, side, q in lots:
        while side == "S" and q > 0 and buys:
            take = min(q, buys[0][1])
            out[buys[0][0], ref] = out.get((buys[0][0], ref), 0) + take
            q, buys[0][1] = q - take, buys[0][1] - take
            if not buys[0][1]:
                buys.pop(0)
    return sorted((*k, v) for k, v in out.items())


@pytest.mark.parametrize("seed", range(4))
def test_fifo_against_a_loop(spark, seed):
    rng = random.Random(seed)
    lots = [(i, rng.choice("BS"), rng.randint(0, 9)) for i in range(40)]
    df = spark.createDataFrame([("k", *x) for x in lots], "g string, ref int, side string, q long")
    found = Q.fifo_matches(df, "g", ["ref"], F.col("side") == "B", "q", "ref")
    assert rows(found, "buy_ref", "sell_ref", "matched") == fifo_by_hand(lots)


def test_basis_gap(spark):
    df = spark.createDataFrame([("a", "B", 70), ("a", "S", 100), ("b", "B", 5)], "g string, side string, q long")
    assert rows(Q.basis_gaps(df, "g", F.col("side") == "B", "q"), "g", "uncovered") == [("a", 30), ("b", 0)]


def test_rate_bands_are_open_below(spark):
    df = spark.createDataFrame([("0",), ("100.00",), ("100.01",), ("250.00",)], "x string").select(F.col("x").cast("decimal(20,2)").alias("x"))
    found = df.select("x", *Q.band_charge(df, "x", [("0", "100", "0.10"), ("100", None, "0.25")])).orderBy("x").collect()
    assert [(int(r["tax"]), r["band"]) for r in found] == [(0, None), (10, 0), (10, 1), (48, 1)]


def test_islands_with_null_keys_and_cuts(spark):
    df = spark.createDataFrame([("g", i, k) for i, k in enumerate(["a", "a", None, None, "a", "a", "a"])], "g string, i int, k string")
    found = Q.islands(df, "g", ["i"], F.col("k"), most=2).orderBy("i").collect()
    assert [(r["island"], r["part"]) for r in found] == [(1, 0), (1, 0), (2, 0), (2, 0), (3, 0), (3, 0), (3, 1)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    found = dict(rows(Q.connected(edges, store.saved), "node", "component"))
    assert found == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}


def test_greedy_bins_and_running_means(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 5, 11, 1, 9])], "d string, i int, n int")
    assert [r[1] for r in rows(Q.greedy_bins(df, "d", "i", "n", 10), "i", "bin")] == [0, 0, 1, 2, 2]
    xs = spark.createDataFrame([("d", x) for x in [1.0, 2.0, 3.4, 9.0]], "d string, x double")
    assert [r[1] for r in rows(Q.running_mean_clusters(xs, "d", "x", 2.0), "x", "cluster")] == [0, 0, 0, 1]


def test_merge_upsert_states(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "k int, v string, r int")
    delta = spark.createDataFrame([(2, "x", 2), (3, "x", 0), (4, "d", 1)], "k int, v string, r int")
    assert rows(J.merge_upsert(base, delta, ["k"], "v", "r"), "k", "action", "v") == [(1, "unchanged", "a"), (2, "superseded", "x"), (3, "conflict", "c"), (4, "added", "d")]


def test_bucketed_overlaps_find_each_pair_once(spark):
    rng = random.Random(1)
    spans = [(i, "g", lo, lo + rng.randint(0, 30)) for i in range(60) for lo in [rng.randint(0, 100)]]
    df = spark.createDataFrame(spans, "i int, g string, lo int, hi int")
    wanted = sorted((a[0], b[0]) for a in spans for b in spans if a[2] <= b[3] and b[2] <= a[3])
    assert rows(J.boxes_touching(df, df, "g", "lo", "hi", 7), "l_i", "r_i") == wanted


def test_gates_treat_null_as_failed(spark):
    df = spark.createDataFrame([(1, None), (2, True)], "i int, ok boolean")
    assert rows(df.select("i", *A.gates({"ok": F.col("ok")})), "i", "passed", "failed") == [(1, False, "ok"), (2, True, "")]


def test_costs_round_up(spark):
    df = spark.createDataFrame([(3,)], "n long").select(A.ceil_cost(F.col("n"), F.lit("0.0000000001"), 9).alias("c"))
    assert str(df.first()["c"]) in ("1E-9", "0.000000001")


def test_paging_and_filters(spark):
    df = spark.range(100)
    assert [r["id"] for r in S.page(df, [F.col("id")], 5, 10).collect()] == [10, 11, 12, 13, 14]
    with pytest.raises(ValueError):
        S.page(df, [F.col("id")], 0)
    assert S.normalized_filter("  a  b ") == "A B" and S.normalized_filter(" ") is None
    assert S.scoped(df, id=[1, 2, 300]).count() == 2


def test_costs_of_a_used_up_lot_add_up(spark):
    """A lot of seven for 100 cents goes to sells of two, two and three; another one of unit cost 100/7 but for a hair bought the same day."""
    lots = [("g", "b1", 1, "B", 7, 100), ("g", "s1", 2, "S", 2, 0), ("g", "s2", 3, "S", 2, 0), ("g", "s3", 4, "S", 3, 0)]
    frame = lambda data: spark.createDataFrame(data, "g string, ref string, day int, side string, q long, cents long")
    found = P.priced_matches(frame(lots), "g", ["day"], F.col("side") == "B", "q", "ref", "cents").collect()
    assert {r["sell_ref"]: r["cost"] for r in found} == {"s1": 28, "s2": 29, "s3": 43}
    near = [("h", "b1", 1, "B", 7 * 10**9, 10**11), ("h", "b2", 1, "B", 7 * 10**9, 10**11 + 1), ("h", "s1", 2, "S", 5, 0), ("i", "b1", 1, "B", 7, 100), ("i", "b2", 1, "B", 14, 200), ("i", "s1", 2, "S", 5, 0)]
    assert [r["g"] for r in P.ambiguous_days(frame(near), "g", "day", F.col("side") == "B", "q", "ref", "cents").collect()] == ["h"]


def test_sequences_of_many_and_no_tokens(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(30))], [rng.choice("abce") for _ in range(rng.randrange(30))]) for _ in range(40)] + [(["x", "y"], None), ([], [])]
    many = [f"t{i}" for i in range(1500)]
    pairs.append((many, many[700:] + many[:700]))

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    found = table.select("i", V.common_length(F.col("a"), F.col("b")).alias("n"), V.sequence_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r["n"] for r in found] == [None if b is None else plain(a, b) for a, b in pairs]
    assert found[41]["d"] == 0 and found[40]["d"] is None and found[42]["d"] == 1400


def test_pages_resume_by_their_token(spark):
    table = spark.range(10)
    first = pages.keyset_page(table, "id", None, 4, "q").collect()
    second = pages.resumed_page(table, "id", first[0]["next_after"], first[0]["continuation"], 4, "q").collect()
    assert [r["id"] for r in first] + [r["id"] for r in second] == list(range(8))
    for after, scope in ((4, "q"), (3, "other")):
        with pytest.raises(ValueError, match="token"):
            pages.resumed_page(table, "id", after, first[0]["continuation"], 4, scope)


def test_csv_rules(spark):
    wide = ";".join(f"c{i}" for i in range(parsers.MOST_COLUMNS + 1)).encode()
    cases = {
        "ragged": (b"port|depth|tide\nOban|12\nWick|9|high|late\n\n", None), "marked": ("\ufeffstadt\tland\nK\u00f6ln\tDE\n".encode(), None), "single_byte": ("\u0433\u043e\u0440\u043e\u0434|\u043a\u043e\u0434\n\u041e\u043c\u0441\u043a|55\n".encode("cp1251"), None),
        "spaces_only": (b"\t \r\n", "empty"), "nameless": (b"port;;tide\n1;2;3\n", "header_blank"), "twice": (b"tide;Port; port \n1;2;3\n", "header_repeated"), "zero_byte": (b"port;tide\nOb\x00an;1\n", "nul_byte"),
        "open_quote": (b'port;note\nOban;"never ends\nWick;2\n', "malformed"), "header_alone": (b"port;tide\n", "header_only"), "columns": (wide + b"\n1;2\n", "too_many_columns"),
        "field": (b"port;note\nOban;" + b"n" * (parsers.MOST_FIELD + 1) + b"\n", "field_too_long"), "missing": (None, "unavailable"),
    }
    df = spark.createDataFrame([(k, bytearray(v[0]) if v[0] is not None else None) for k, v in cases.items()], "id string, content binary")
    found = parsers.read_as(df, "csv").collect()
    assert {r["id"]: r["error"] for r in found} == {k: v[1] for k, v in cases.items()}
    assert [r["cells"] for r in found if r["id"] == "ragged"] == [["port", "depth", "tide"], ["Oban", "12"], ["Wick", "9", "high", "late"], []]
    assert [r["cells"] for r in found if r["id"] == "single_byte"][1] == ["\u041e\u043c\u0441\u043a", "55"]


def test_decimal_literals(spark):
    cases = {
        "8": "8", "12 345": "12345", "12\u00a0345\u202f678,9": "12345678.9", "12,345.60": "12345.60", "-12.345,60": "-12345.60", "+0,07": "+0.07", "1,234": "1.234", "1,234,567": "1,234,567", "1.2.3": "1.2.3", "12,34.5": "12,34.5",
        "1 23": "1 23", "1 234 ": "1 234 ", "1,234 567.8": "1,234 567.8", "": "", "-": "-", "twelve": "twelve", "5.": "5.", ".5": ".5", "1234 567": "1234 567", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", L.decimal_literal(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in df.collect()} == cases


def test_xml_zip_and_html(spark):
    xml = b"<a k='1'>x<b/>y</a>"
    events = parsers.read_as(spark.createDataFrame([(1, bytearray(xml)), (2, bytearray(b"<!DOCTYPE a><a/>")), (3, bytearray(b"<a>"))], "id int, content binary"), "xml").collect()
    assert [(r["type"], r["node_path"], r["value"]) for r in events if r["id"] == 1] == [
        ("start", "/a", None), ("attribute", "/a", "1"), ("text", "/a", "x"), ("start", "/a/b", None), ("end", "/a/b", None), ("text", "/a", "y"), ("end", "/a", None),
    ]
    assert {r["id"]: r["error"] for r in events if r["id"] > 1} == {2: "declaration_forbidden", 3: "malformed"}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("a.csv", "A.CSV", "../b", "d/", "in.zip", ".DS_Store"):
            z.writestr(name, "x")
    members = parsers.read_as(spark.createDataFrame([(1, bytearray(buffer.getvalue()))], "id int, content binary"), "zip")
    assert [r["disposition"] for r in members.orderBy("ordinal").collect()] == ["promoted", "blocked:collision", "blocked:path", "directory", "blocked:nested", "sidecar"]
    html = b"<table><tr><th>A</th><td> </td><td>b<script>no</script>c</td></tr></table>"
    cells = parsers.read_as(spark.createDataFrame([(1, bytearray(html))], "id int, content binary"), "html")
    assert rows(cells, "table", "row", "col", "text") == [(0, 0, 0, "A"), (0, 0, 1, "bc")]


def test_office_files(spark):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>hi</t></si></sst>'
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p/></w:body></w:document>'

    def packed(**files):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, data in files.items():
                z.writestr(name.replace("__", "/") + ".xml", data)
        return spark.createDataFrame([(1, bytearray(buffer.getvalue()))], "id int, content binary")

    cells = parsers.read_as(packed(xl__worksheets__sheet1=sheet, xl__sharedStrings=shared), "xlsx")
    assert {(r["cell"], r["text"], r["is_formula"]) for r in cells.collect()} == {("A1", "hi", False), ("B1", None, True), ("C1", "in", False)}
    assert rows(parsers.read_as(packed(word__document=word), "docx"), "ordinal", "style", "text") == [(0, "Heading1", "T")]


def test_containers(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (7).to_bytes(4, "big") + (5).to_bytes(4, "big")
    df = spark.createDataFrame([("a.pdf", None, bytearray(b"%PDF-1.4")), ("b.xlsx", None, bytearray(b"PK\x03\x04..")), ("c", "text/csv", bytearray(b"a,b")), ("d.png", None, bytearray(png))], "name string, mime string, content binary")
    kind = containers.container(F.col("content"), containers.extension(F.col("name"), F.col("mime")))
    found = df.select("name", kind["format"].alias("f"), kind["basis"].alias("b"), containers.machine_readable(kind["format"]).alias("m"), containers.image_size(F.col("content")).alias("s")).orderBy("name").collect()
    assert [(r["f"], r["b"], r["m"]) for r in found] == [("pdf", "content", "conditional"), ("xlsx", "content", "yes"), ("csv", "metadata", "yes"), ("png", "content", "no")]
    assert tuple(found[3]["s"]) == (7, 5)


def test_transcripts_with_bad_times(spark):
    payload = '{"language": "en", "segments": [{"text": " a ", "start": "x", "end": "1", "speaker": null}, {"text": "b", "start": "1", "end": "2.5", "speaker": "s"}]}'
    t = spark.createDataFrame([(payload,)], "p string").select(transcripts.normalized(F.col("p")).alias("t"))
    assert t.select(transcripts.rendered(F.col("t.segments"))).first()[0] == "a\n[1.0-2.5] s: b"
    assert t.first()["t"]["text"] == "a b"


def test_comparable_numbers(spark):
    df = spark.createDataFrame([("007.50",), ("0",), ("-2.0",), (" a  b",), (None,)], "x string").select(L.comparable(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == ["7.5", "0", "-2", "A B", None]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.event_stream(spark, str(tmp_path / "in"))
    running = stream.windowed_counts(source, "1 day", "60 days").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    running.processAllAvailable()
    running.stop()
    key = ["begin", "event_type", "n", "total"]
    assert rows(spark.table("counts"), *key) == rows(stream.windowed_counts(events, "1 day"), *key)


def plain_clusters(values, tolerance):
    means, out = [], []
    for x in sorted(values):
        i = next((i for i, m in enumerate(means) if abs(x - sum(m) / len(m)) <= tolerance), len(means))
        means += [[]] if i == len(means) else []
        means[i].append(x)
        out.append((x, i))
    return out


def plain_lines(words, tolerance):
    lines, out = [], []
    for x, ordinal in sorted(words):
        i = next((i for i in range(len(lines) - 1, -1, -1) if abs(x - lines[i][len(lines[i]) // 2]) <= tolerance), len(lines))
        lines += [[]] if i == len(lines) else []
        lines[i].append(x)
        out.append((ordinal, i))
    return out


def test_clusters_and_lines_equal_plain_folds(spark):
    rng = random.Random(8)
    words = [(g, i, float(rng.choice([rng.randrange(12), rng.randrange(90), 500 + rng.randrange(9)]))) for g in "abc" for i in range(150)]
    table = spark.createDataFrame([*words, ("a", 900, None), ("d", 901, 4.0)], "g string, i int, x double")
    clusters, lines = Q.running_mean_clusters(table, "g", "x", 2.5).collect(), Q.median_lines(table, "g", "x", "i", 2.5).collect()
    for g in "abc":
        own = [(x, i) for k, i, x in words if k == g]
        assert sorted((r["x"], r["cluster"]) for r in clusters if r["g"] == g) == sorted(plain_clusters([x for x, _ in own], 2.5))
        assert sorted((r["i"], r["line"]) for r in lines if r["g"] == g) == sorted(plain_lines(own, 2.5))
    assert [(r["x"], r["cluster"]) for r in clusters if r["g"] == "d"] == [(4.0, 0)] and len(clusters) == len(lines) == 451


@pytest.mark.parametrize("seed", range(3))
def test_touching_totals_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice("ab"), rng.randrange(40), float(x := rng.randrange(12)), 0.0, x + rng.choice([0.0, 3.0]), 1.0 + rng.randrange(2)) for _ in range(60)] + [("a", None, 1.0, 0.0, 4.0, 1.0), (None, 1, 1.0, 0.0, 4.0, 1.0)]
    wanted = {}
    for i, a in enumerate(data[:60]):
        for b in data[:i]:
            if a[0] == b[0] and a[1] != b[1] and a[2] <= b[4] and b[2] <= a[4]:
                common = max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
                area = sum((x[4] - x[2]) * (x[5] - x[3]) for x in (a, b))
                n, best = wanted.get(a[0], (0, 0.0))
                wanted[a[0]] = n + 1, max(best, common / (area - common) if common else 0.0)
    df = spark.createDataFrame(data, "g string, k int, x0 double, y0 double, x1 double, y1 double")
    assert rows(J.touching_totals(df, "g", "k", ["x0", "y0", "x1", "y1"], 7), "g", "pairs", "best") == sorted((g, *v) for g, v in wanted.items())


def test_iou_pairs_of_a_crowded_page(spark, tmp_path):
    from tallyforge.plans.joining import iou_pairs

    n = 200_000  # 2 * 10^10 pairs, which can't be listed
    spark.range(n).selectExpr("id * 5 p_partkey", "'b' p_brand", "'t' p_type", "7 p_size").write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in iou_pairs(spark, str(tmp_path)).collect()] == [("b", n * (n - 1) // 2, 1.0)]


def test_annotations_of_a_target_are_one_aggregate(spark, tmp_path):
    from tallyforge.plans.surface import annotation_atomicity

    data = [(1, 1, 5), (1, 2, 5), (1, 2, 5), (1, 3, 5), (1, 3, 6), (2, 1, 5), (2, 1, 6), (2, 1, 7), (2, 1, 7), (2, 2, None), (2, 3, None), (2, 3, 4), (3, 1, None), (3, 1, None), (3, 2, None), (3, 2, 1), (3, 2, 1), (None, 1, 1), (None, 1, 2), (None, 1, 3)]
    spark.createDataFrame(data, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = annotation_atomicity(spark, str(tmp_path))
    targets = [r[:2] for r in data]
    assert {tuple(r) for r in found.collect()} == {(*r, "materialized" if targets.count(r[:2]) == 1 else "presence") for r in data}
    assert found.count() == len(set(data)) and "Window" not in found._jdf.queryExecution().toString()


def test_replay_appends_a_batch_and_reads_at_the_timer():
    from types import SimpleNamespace

    from tallyforge.streaming import replay

    class State:
        def __init__(self):
            self.rows, self.calls = [], []

        def __getattr__(self, name):
            return lambda *a: self.calls.append(name) or {"get": lambda: iter(self.rows), "appendList": lambda rows: self.rows.extend(rows), "clear": self.rows.clear}[name](*a)

    one = replay.Replay(100)
    one.entries, at, timers = State(), [], []
    one.deadline = SimpleNamespace(get=lambda: at[-1] if at else None, update=at.append, clear=at.clear)
    one.handle = SimpleNamespace(registerTimer=timers.append, deleteTimer=timers.remove)
    rows = lambda *x: iter([dict(zip(("kind", "entry", "at"), r, strict=True)) for r in x])
    assert not list(one.handleInputRows((5,), rows(("expected", 1, 10), ("seen", 1, 12), ("seen", 1, 11), ("seen", 9, 12), ("expected", 2, 20)), None))
    assert not list(one.handleInputRows((5,), rows(("seen", 2, 75), ("expected", 3, 15), ("seen", 4, 1)), None))
    assert one.entries.calls == ["appendList"] * 2 and timers == [120]  # before: two or three calls for each row
    [found] = one.handleExpiredTimer((5,), None, None)
    assert tuple(found) == (5, 3, 2, 1, 1, 2, 1, "incomplete")


def test_stitched_columns_are_dealt_by_rows(spark, monkeypatch):
    from tallyforge.plans import assembly

    monkeypatch.setattr(assembly, "_TASK_ROWS", 200)
    found = assembly.stitched_columns(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= 30  # before: as few as the shuffle's size asked for
