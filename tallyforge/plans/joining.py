"""Queries of joins: reconciliation, parity, overlap, adjacency, coverage, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import money
from ..operators import joins as J
from ..operators.aggregates import control_totals
from .base import Tables, query


@query("""SELECT o_orderkey, CAST(o_custkey % 7 AS BIGINT) AS declared, count(l_orderkey) AS actual,
CASE WHEN o_custkey % 7 = count(l_orderkey) THEN 'current' ELSE 'corrupt' END AS status
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey""")
def generation_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared counts (a stand-in) against actual facts."""
    t = Tables(spark, sf_dir)
    declared = t.orders.select("o_orderkey", (F.col("o_custkey") % 7).alias("n"))
    return J.count_reconcile(declared, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "n")


@query("""SELECT o_orderkey, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(20,2))), 0) - CAST(o_totalprice AS DECIMAL(20,2)) AS DECIMAL(30,2)) AS gap_amount,
CASE WHEN coalesce(sum(CAST(l_extendedprice AS DECIMAL(20,2))), 0) = CAST(o_totalprice AS DECIMAL(20,2)) THEN 'reconciled' ELSE 'mismatch' END AS status
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def reconcile_control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of lines against printed order totals."""
    t = Tables(spark, sf_dir)
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), money(F.col("l_extendedprice")).alias("amount"))
    return control_totals(lines, t.orders.select("o_orderkey", money(F.col("o_totalprice")).alias("total")), "o_orderkey", {"amount": "total"})


@query("""WITH l AS (SELECT p_name, p_brand, count(*) AS left_rows FROM part WHERE p_size <= 25 GROUP BY ALL), r AS (SELECT p_name, p_brand, count(*) AS right_rows FROM part WHERE p_size > 20 GROUP BY ALL)
SELECT p_name, p_brand, coalesce(left_rows, 0) AS left_rows, coalesce(right_rows, 0) AS right_rows,
CASE WHEN right_rows IS NULL THEN 'left_only' WHEN left_rows IS NULL THEN 'right_only' WHEN left_rows = 1 AND right_rows = 1 THEN 'matched' ELSE 'not_unique' END AS status FROM l FULL JOIN r USING (p_name, p_brand)""")
def exact_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Tables(spark, sf_dir).part
    return J.exact_match(part.where("p_size <= 25"), part.where("p_size > 20"), ["p_name", "p_brand"])


@query("""WITH rows AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS header FROM lineitem GROUP BY l_orderkey), m(header, mapping) AS (VALUES ('A', 'accepted'), ('R', 'returned'), ('A,R', 'mixed'), ('A,N,R', 'complete'))
SELECT l_orderkey, mapping FROM rows JOIN m USING (header)""")
def header_fingerprint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose whole header equals a mapping's, through a fingerprint of the ordered header."""
    header = F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",")
    rows = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.sha2(header, 256).alias("fingerprint"))
    known = spark.createDataFrame([("A", "accepted"), ("R", "returned"), ("A,R", "mixed"), ("A,N,R", "complete")], "header string, mapping string")
    return rows.join(F.broadcast(known.select(F.sha2("header", 256).alias("fingerprint"), "mapping")), "fingerprint").select("l_orderkey", "mapping")


@query("""SELECT a.l_orderkey, a.l_linenumber AS amount_line, b.l_linenumber AS unit_line, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'N' AND b.l_returnflag = 'R' AND a.l_quantity > b.l_quantity GROUP BY ALL""")
def row_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two kinds that stand in one row, paired."""
    lines = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    amounts = lines.where("l_returnflag = 'N'").select("l_orderkey", F.col("l_linenumber").alias("amount_line"), F.col("l_quantity").alias("amount"))
    units = lines.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("unit_line"), F.col("l_quantity").alias("unit"))
    return amounts.join(units, "l_orderkey").where("amount > unit").groupBy("l_orderkey", "amount_line", "unit_line").agg(F.count("*").alias("pairs"))


@query("""SELECT a.conv_id, a.turn AS turn, length(b.text) - length(a.text) AS growth FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""")
def adjacency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit and the one on the next page that continues it, unique both ways."""
    pairs = J.adjacent(Tables(spark, sf_dir).conversations, "conv_id", "turn", F.expr("l.role = 'user' AND r.role = 'assistant'"))
    return pairs.select("conv_id", F.col("l.turn").alias("turn"), (F.length("r.text") - F.length("l.text")).cast("long").alias("growth"))


@query("""WITH s AS (SELECT l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS low, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS high FROM lineitem)
SELECT a.l_suppkey, count(*) AS overlaps, CAST(sum(least(a.high, b.high) - greatest(a.low, b.low)) AS BIGINT) AS days FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.low <= b.high AND b.low <= a.high GROUP BY a.l_suppkey""")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs of a group's intervals, each with itself too, and the days they share: sums over cut points, no pair is listed."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01"))
    spans = Tables(spark, sf_dir).lineitem.select("l_suppkey", day.alias("low"), (day + F.col("l_quantity").cast("int")).alias("high"))
    return J.overlap_totals(spans, "l_suppkey", "low", "high").select("l_suppkey", F.col("pairs").alias("overlaps"), F.col("length").alias("days"))


@query("""WITH b AS (SELECT p_partkey, p_brand, p_type, CAST(p_size AS DOUBLE) AS x0, p_size + 5.0 AS x1, 0.0 AS y0, 10.0 + p_partkey % 5 AS y1 FROM part)
SELECT a.p_brand, count(*) AS pairs, round(max(CASE WHEN w * h > 0 THEN w * h / (aa + bb - w * h) ELSE 0 END), 6) AS best FROM (
SELECT a.p_brand, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) AS w, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS h, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS bb
FROM b a JOIN b b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND a.x0 <= b.x1 AND b.x0 <= a.x1) a GROUP BY a.p_brand""")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page that touch, with their intersection over union; equal boxes are counted, not paired."""
    page = F.when(F.col("p_brand").isNotNull() & F.col("p_type").isNotNull(), F.struct("p_brand", "p_type"))
    boxes = Tables(spark, sf_dir).part.select(
        page.alias("page"), "p_partkey", F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 5.0).alias("x1"), F.lit(0.0).alias("y0"), (10.0 + F.col("p_partkey") % 5).alias("y1")
    )
    found = J.touching_totals(boxes, "page", "p_partkey", ["x0", "y0", "x1", "y1"], 8.0)
    return found.groupBy("page.p_brand").agg(F.sum("pairs").alias("pairs"), F.round(F.max("best"), 6).alias("best"))


@query("""SELECT event_id, o_orderkey FROM events JOIN orders ON user_id = o_custkey AND value * 1000 BETWEEN o_totalprice - 2000 AND o_totalprice + 2000""")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the ranges of their group: an equality and a range."""
    t = Tables(spark, sf_dir)
    points = t.events.select("event_id", F.col("user_id").alias("o_custkey"), (F.col("value") * 1000).alias("at"))
    return points.join(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey").where("at BETWEEN o_totalprice - 2000 AND o_totalprice + 2000").select("event_id", "o_orderkey")


@query("""WITH bands(brand, low, high, label) AS (VALUES ('Brand#1', 1, 20, 'small'), ('Brand#1', 21, 40, 'medium'), ('Brand#2', 10, 30, 'middle'), ('Brand#3', 1, 50, 'any'))
SELECT p_partkey, coalesce(label, p_type) AS label FROM part LEFT JOIN bands ON p_brand = brand AND p_size BETWEEN low AND high""")
def span_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the span that covers a cell, else the cell's own."""
    bands = spark.createDataFrame([("Brand#1", 1, 20, "small"), ("Brand#1", 21, 40, "medium"), ("Brand#2", 10, 30, "middle"), ("Brand#3", 1, 50, "any")], "brand string, low int, high int, label string")
    part = Tables(spark, sf_dir).part
    covered = (part["p_brand"] == bands["brand"]) & part["p_size"].between(bands["low"], bands["high"])
    return part.join(F.broadcast(bands), covered, "left").select("p_partkey", F.coalesce("label", "p_type").alias("label"))


@query("""WITH f AS (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id), d(demand, needs) AS (VALUES ('dialog', ['user', 'assistant']), ('instructed', ['system', 'user']), ('monologue', ['user']))
SELECT conv_id, demand FROM f JOIN d ON len(list_filter(needs, lambda x: NOT list_contains(roles, x))) = 0""")
def evidence_demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.collect_set("role").alias("roles")).withColumn("kind", F.lit("conversation"))
    demands = spark.createDataFrame([("conversation", "dialog", ["user", "assistant"]), ("conversation", "instructed", ["system", "user"]), ("conversation", "monologue", ["user"])], "kind string, demand string, required_roles array<string>")
    return J.demand_matches(F.broadcast(demands), facts).select("conv_id", "demand")


@query("""SELECT c_custkey, CASE WHEN a IS NOT NULL THEN 'urgent' WHEN b IS NOT NULL THEN 'finished' WHEN c IS NOT NULL THEN 'any' ELSE 'gap' END AS source, coalesce(a, b, c) AS value FROM customer
LEFT JOIN (SELECT o_custkey, min(o_orderkey) a FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1) x ON c_custkey = x.o_custkey
LEFT JOIN (SELECT o_custkey, min(o_orderkey) b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) y ON c_custkey = y.o_custkey
LEFT JOIN (SELECT o_custkey, min(o_orderkey) c FROM orders GROUP BY 1) z ON c_custkey = z.o_custkey""")
def priority_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    done = orders.where("o_orderstatus = 'F'")
    return J.first_of(t.customer.select("c_custkey"), "c_custkey", [("urgent", done.where("o_orderpriority = '1-URGENT'"), "o_orderkey"), ("finished", done, "o_orderkey"), ("any", orders, "o_orderkey")])


@query("""WITH a AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 10 <> 3), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 4)
SELECT p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'MISSING' WHEN a.p_partkey IS NULL THEN 'EXTRA' WHEN a.p_name = b.p_name AND a.p_size = b.p_size THEN 'MATCH' ELSE 'WRONG' END AS status,
CASE WHEN a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL AND NOT (a.p_name = b.p_name AND a.p_size = b.p_size) THEN concat_ws(',', CASE WHEN a.p_name <> b.p_name THEN 'p_name' END, CASE WHEN a.p_size <> b.p_size THEN 'p_size' END) END AS changed FROM a FULL JOIN b USING (p_partkey)""")
def parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    other = part.where(key % 10 != 4).withColumns({"p_name": F.when(key % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")), "p_size": F.when(key % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))})
    return J.full_outer_diff(part.where(key % 10 != 3), other, ["p_partkey"], ["p_name", "p_size"])


@query("""WITH l AS (SELECT CAST(p_partkey // 10 AS BIGINT) AS g, p_partkey % 10 // 5 AS r, p_partkey % 5 AS c, p_name AS t FROM part WHERE p_partkey % 13 <> 0), x AS (SELECT CAST(p_partkey // 10 AS BIGINT) AS g, p_partkey % 10 // 5 AS r, p_partkey % 5 AS c, CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE p_name END AS t FROM part WHERE p_partkey % 17 <> 0), e AS (SELECT DISTINCT g, t FROM x)
SELECT g, r, c, CASE WHEN l.t IS NULL THEN 'extra' WHEN x.t IS NOT NULL AND l.t = x.t THEN 'same' WHEN e.t IS NOT NULL THEN 'moved' WHEN x.t IS NULL THEN 'omitted' ELSE 'text' END AS status FROM l FULL JOIN x USING (g, r, c) LEFT JOIN e ON e.g = g AND e.t = l.t""")
def cell_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    cells = Tables(spark, sf_dir).part.select("p_partkey", F.expr("p_partkey div 10").alias("g"), F.expr("(p_partkey % 10) div 5").alias("r"), (key % 5).alias("c"), F.col("p_name").alias("t"), "p_type")
    right = cells.where(key % 17 != 0).withColumn("t", F.when(key % 9 == 0, F.col("p_type")).otherwise(F.col("t")))
    return J.cell_diff(cells.where(key % 13 != 0), right, "g", "r", "c", "t")


@query("""SELECT user_id, arg_max(event_type, event_id) AS owner, count(DISTINCT event_type) AS owners, count(*) > count(DISTINCT event_type) AS repeated FROM events GROUP BY user_id""")
def last_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last observation owns a ref; whether others did before."""
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("owner"), F.countDistinct("event_type").alias("owners")).join(
        Tables(spark, sf_dir).events.groupBy("user_id").agg((F.count("*") > F.countDistinct("event_type")).alias("repeated")), "user_id"
    )


@query("""SELECT i.item_id, count(*) AS documents FROM (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM benchmark) WHERE length(w) >= 12) i
JOIN (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents) WHERE length(w) >= 12) d USING (w) GROUP BY i.item_id""")
def field_text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields found in texts: distinct long words of either side, joined by the word."""
    t = Tables(spark, sf_dir)
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).where("length(w) >= 12")
    return words(t.benchmark, "item_id").join(words(t.documents, "doc_id"), "w").groupBy("item_id").agg(F.count("*").alias("documents"))


@query("""WITH b AS (SELECT c_custkey, c_mktsegment AS v, 1 AS rank FROM customer WHERE c_custkey % 5 <> 0), d AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS v, CAST(c_custkey % 3 AS INTEGER) AS rank FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, action, CASE WHEN action IN ('added', 'superseded') THEN dv ELSE bv END AS v FROM (SELECT c_custkey, b.v AS bv, d.v AS dv, CASE WHEN d.v IS NULL THEN 'unchanged' WHEN b.v IS NULL THEN 'added' WHEN b.v = d.v THEN 'unchanged' WHEN d.rank > b.rank THEN 'superseded' ELSE 'conflict' END AS action FROM b FULL JOIN d USING (c_custkey))""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = Tables(spark, sf_dir).customer.select("c_custkey", F.col("c_mktsegment").alias("v"))
    delta = rows.where(key % 2 == 0).withColumns({"v": F.when(key % 4 == 0, "NEW").otherwise(F.col("v")), "rank": (key % 3).cast("int")})
    return J.merge_upsert(rows.where(key % 5 != 0).withColumn("rank", F.lit(1)), delta, ["c_custkey"], "v", "rank")


@query("""WITH s AS (SELECT doc_id FROM documents), d AS (SELECT doc_id FROM labels WHERE quality = 1), n AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT (SELECT count(*) FROM s WHERE doc_id NOT IN (FROM d) AND doc_id NOT IN (FROM n)) AS uncovered, (SELECT count(*) FROM d WHERE doc_id IN (FROM n)) AS in_both,
(SELECT count(*) FROM (FROM d UNION FROM n) WHERE doc_id NOT IN (FROM s)) AS unselected, false AS complete""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return J.set_coverage(t.documents, t.labels.where("quality = 1"), t.labels.where("toxic = 1"), "doc_id")
