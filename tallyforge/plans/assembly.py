"""Queries that assemble, bind, compare and validate records of several tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import validation as C
from .base import Tables, query


@query("""SELECT 'customer.nation' AS rule, count(*) AS violations FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'lineitem.order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)
UNION ALL SELECT 'lineitem.unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'orders.unique', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)""")
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys without a parent, and keys that aren't unique, by rule; parts above size 40 count as unpublished."""
    t = Tables(spark, sf_dir)
    found = [
        C.orphans(t.customer, "c_nationkey", t.nation, "n_nationkey", "customer.nation"),
        C.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "lineitem.order"),
        C.orphans(t.lineitem, "l_partkey", t.part.where("p_size <= 40"), "p_partkey", "lineitem.part"),
        C.repeated(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem.unique"),
        C.orphans(t.orders, "o_custkey", t.customer, "c_custkey", "orders.customer"),
        C.repeated(t.orders, ["o_orderkey"], "orders.unique"),
    ]
    return C.all_rules(found)


@query("""WITH l AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, min(l_shipdate) AS day, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, concat_ws(',', CASE WHEN l.cents IS DISTINCT FROM CAST(round(o_totalprice * 100) AS BIGINT) THEN 'value' END, CASE WHEN (l.cents > 0) IS DISTINCT FROM (o_totalprice > 0) THEN 'sign' END,
CASE WHEN year(l.day) IS DISTINCT FROM year(o_orderdate) THEN 'period' END, CASE WHEN l.n IS NULL THEN 'binding' END) AS failed FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) SELECT o_orderkey, failed, failed = '' AS passed FROM c""")
def metric_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated metric against the one computed from its rows: every check that fails, by name."""
    t = Tables(spark, sf_dir)
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.min("l_shipdate").alias("day"), F.count("*").alias("n"))
    stated = F.round(F.col("o_totalprice") * 100).cast("long")
    checks = {
        "value": F.col("cents").eqNullSafe(stated),
        "sign": (F.col("cents") > 0).eqNullSafe(F.col("o_totalprice") > 0),
        "period": F.year("day").eqNullSafe(F.year("o_orderdate")),
        "binding": F.col("n").isNotNull(),
    }
    failed = F.array_join(C.failed(checks), ",")
    return t.orders.join(rows, "o_orderkey", "left").select("o_orderkey", failed.alias("failed"), (failed == "").alias("passed"))


@query("""SELECT a.o_orderkey, concat_ws(',', CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'kind' END, CASE WHEN abs(CAST(round(a.o_totalprice) AS BIGINT) - CAST(round(b.o_totalprice) AS BIGINT)) > 50000 THEN 'distance' END,
CASE WHEN abs(date_diff('day', a.o_orderdate, b.o_orderdate)) > 365 THEN 'period' END, CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'status' END) AS reasons FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""")
def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours and the conditions of a continuation that they don't meet; an equality carries the join."""
    rows = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority", F.round("o_totalprice").cast("long").alias("price"), "o_orderdate", "o_orderstatus")
    pairs = rows.alias("a").join(rows.alias("b"), F.col("b.o_orderkey") == F.col("a.o_orderkey") + 1)
    checks = {
        "kind": F.expr("a.o_orderpriority = b.o_orderpriority"),
        "distance": F.expr("abs(a.price - b.price) <= 50000"),
        "period": F.expr("abs(datediff(b.o_orderdate, a.o_orderdate)) <= 365"),
        "status": F.expr("a.o_orderstatus = b.o_orderstatus"),
    }
    return pairs.select("a.o_orderkey", F.array_join(C.failed(checks), ",").alias("reasons"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CASE WHEN o_orderstatus = 'F' THEN 'bound' ELSE 'inactive' END ELSE 'no_authority' END AS outcome FROM orders""")
def demand_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demands to the profile that answers for their type: bound, inactive, or without authority."""
    profiles = spark.createDataFrame([("1-URGENT", "F"), ("2-HIGH", "F")], "o_orderpriority string, active string")
    outcome = F.when(F.col("active").isNull(), "no_authority").when(F.col("o_orderstatus") == F.col("active"), "bound").otherwise("inactive")
    return Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority", "o_orderstatus").join(profiles, "o_orderpriority", "left").select("o_orderkey", outcome.alias("outcome"))


@query("""WITH l AS (SELECT *, l_linenumber * 1 AS k FROM lineitem) SELECT l_orderkey, 'flags' AS dimension, coalesce(string_agg(l_returnflag, ',' ORDER BY k, l_partkey, l_suppkey, l_returnflag), '') = coalesce(string_agg(l_returnflag, ',' ORDER BY k, l_partkey, l_suppkey, l_returnflag) FILTER (k < 6), '') AS equal FROM l GROUP BY 1
UNION ALL SELECT l_orderkey, 'parts', coalesce(string_agg(l_partkey, ',' ORDER BY k, l_partkey), '') = coalesce(string_agg(CASE WHEN l_partkey % 50 = 0 THEN -1 ELSE l_partkey END, ',' ORDER BY k, l_partkey), '') FROM l GROUP BY 1""")
def checklist_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item lists of two renderings of an order, compared by dimension through their digests."""
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    shown = F.when(F.col("l_partkey") % 50 == 0, -1).otherwise(F.col("l_partkey"))
    lists = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), shown.alias("shown")))).alias("items"))

    def digest(of, where=None):
        items = F.filter("items", where) if where else F.col("items")
        return F.sha2(F.to_json(F.transform(items, of)), 256)

    flags = digest(lambda x: x["key"]["l_returnflag"]) == digest(lambda x: x["key"]["l_returnflag"], lambda x: x["key"]["l_linenumber"] < 6)
    parts = digest(lambda x: x["key"]["l_partkey"]) == digest(lambda x: x["shown"])
    sides = F.array(F.struct(F.lit("flags").alias("dimension"), flags.alias("equal")), F.struct(F.lit("parts").alias("dimension"), parts.alias("equal")))
    return lists.select("l_orderkey", F.inline(sides))


_VIEWS = {"free": "l_returnflag", "candidate": "l_linestatus", "parser": "CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END", "reference": "CASE WHEN l_suppkey % 3 > 0 THEN l_linestatus END"}
_PAIRS = list(combinations(_VIEWS, 2))


@query(
    "WITH g AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"min({e}) AS {v}" for v, e in _VIEWS.items()) + " FROM lineitem GROUP BY 1, 2) "
    + " UNION ALL ".join(f"SELECT '{a}/{b}' AS pair, count(*) FILTER ({a} = {b}) AS equal, count(*) FILTER ({a} <> {b}) AS different, count(*) FILTER ({b} IS NULL AND {a} IS NOT NULL) AS left_only, count(*) FILTER ({a} IS NULL AND {b} IS NOT NULL) AS right_only FROM g" for a, b in _PAIRS)
)
def grid_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four views of a grid, compared cell by cell in six pairs: the views meet in one aggregate, not in joins."""
    grid = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", "l_linenumber").agg(*(F.min(F.expr(e)).alias(v) for v, e in _VIEWS.items()))
    cells = grid.select(F.inline(F.array(*(F.struct(F.lit(f"{a}/{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in _PAIRS))))
    return cells.groupBy("pair").agg(
        F.count_if(F.expr("a = b")).alias("equal"), F.count_if(F.expr("a <> b")).alias("different"), F.count_if(F.expr("b IS NULL AND a IS NOT NULL")).alias("left_only"), F.count_if(F.expr("a IS NULL AND b IS NOT NULL")).alias("right_only")
    )


@query("""WITH s AS (SELECT l_orderkey, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey) AS e, list(l_suppkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_sort(list_distinct(e)) = list_sort(list_distinct(a)) AS same_set, e = a AS same_sequence, array_to_string(list_sort(list_filter(list_distinct(e), lambda x: NOT list_contains(a, x))), ',') AS missing,
array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(e, x))), ',') AS extra, CAST(len(a) - len(list_distinct(a)) AS INTEGER) AS duplicates FROM s""")
def sequence_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and returned ids of a query case: as sets, as sequences, and what differs."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    own = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(lines.alias("x")).select("l_orderkey", F.transform("x", lambda v: v["l_partkey"] % 5).alias("e"), F.transform("x", lambda v: v["l_suppkey"] % 5).alias("a"))

    def listed(one: str, other: str):
        return F.array_join(F.array_sort(F.array_except(one, other)).cast("array<string>"), ",")

    same_set = F.array_sort(F.array_distinct("e")) == F.array_sort(F.array_distinct("a"))
    return own.select("l_orderkey", same_set.alias("same_set"), (F.col("e") == F.col("a")).alias("same_sequence"), listed("e", "a").alias("missing"), listed("a", "e").alias("extra"), (F.size("a") - F.size(F.array_distinct("a"))).alias("duplicates"))


@query("SELECT event_id, first_id, event_id <> first_id AS duplicate FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_id FROM events)")
def duplicate_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows of a key point to its first; the key's least ordinal is aggregated before the join, so a hot key is one row there."""
    rows = Tables(spark, sf_dir).events.select("user_id", "event_type", "event_id")
    first = rows.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return rows.join(first, ["user_id", "event_type"]).select("event_id", "first_id", (F.col("event_id") != F.col("first_id")).alias("duplicate"))


@query("""SELECT conv_id, CASE WHEN count(*) = count(DISTINCT turn) THEN 'merged' ELSE 'duplicate' END AS status, CASE WHEN count(*) = count(DISTINCT turn) THEN sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) END AS merged_sha256 FROM conversations GROUP BY 1""")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined in order; a repeated place is an error and gives no text."""
    own = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    clean = F.size("x") == F.size(F.array_distinct(F.transform("x", lambda v: v["turn"])))
    text = F.array_join(F.transform("x", lambda v: v["text"]), "\n")
    return own.select("conv_id", F.when(clean, "merged").otherwise("duplicate").alias("status"), F.when(clean, F.sha2(text.cast("binary"), 256)).alias("merged_sha256"))


#: Rows of a task whose sort and hash tables take some tens of MB.
_TASK_ROWS = 500_000

_CLUSTERS = """WITH g AS (SELECT l_partkey, l_orderkey, CAST(l_quantity AS BIGINT) AS x, l_linenumber AS band FROM lineitem), m AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY l_partkey ORDER BY x, band, l_orderkey) > 2 THEN 1 ELSE 0 END AS fresh FROM g),
c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY l_partkey ORDER BY x, band, l_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM m)"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a part (its lines), their places (quantities) in clusters with gaps of at most 2. The order is total: place, band, order.

    Tasks are dealt by the number of rows, not by what they weigh in the shuffle, where they are packed tight: so one's memory doesn't grow with the table."""
    w = Window.partitionBy("l_partkey").orderBy("x", "band", "l_orderkey")
    lines = Tables(spark, sf_dir).lineitem
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // _TASK_ROWS))
    words = lines.select("l_partkey", "l_orderkey", F.col("l_quantity").cast("long").alias("x"), F.col("l_linenumber").alias("band")).repartition(tasks, "l_partkey")
    fresh = words.withColumn("fresh", F.when(F.col("x") - F.lag("x").over(w) > 2, 1).otherwise(0))
    return fresh.withColumn("cluster", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))


@query(f"{_CLUSTERS} SELECT l_partkey, count(*) FILTER (bands >= 3) AS columns, count(*) FILTER (bands >= 3) >= 2 AS aligned FROM (SELECT l_partkey, cluster, count(DISTINCT band) AS bands FROM c GROUP BY 1, 2) GROUP BY 1")
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are evident where two clusters of places recur in three or more rows."""
    bands = _clusters(spark, sf_dir).groupBy("l_partkey", "cluster").agg(F.count_distinct("band").alias("bands"))
    columns = F.count_if(F.col("bands") >= 3)
    return bands.groupBy("l_partkey").agg(columns.alias("columns"), (columns >= 2).alias("aligned"))


@query(f"{_CLUSTERS} SELECT l_partkey, cluster, CAST(sum(x) // count(*) AS BIGINT) AS place, count(DISTINCT band) AS bands FROM c GROUP BY 1, 2")
def stitched_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column places of several windows that lie within the tolerance become one, at their mean (rounded down)."""
    return _clusters(spark, sf_dir).groupBy("l_partkey", "cluster").agg(F.expr("sum(x) div count(*)").alias("place"), F.count_distinct("band").alias("bands"))


@query("""WITH w AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber <= 2)
SELECT DISTINCT a.l_orderkey, sha256(a.l_returnflag || '|' || b.l_returnflag) AS combination FROM w a JOIN w b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_linestatus = b.l_linestatus""")
def window_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatible combinations of the readings of two windows; a window has at most six readings (flags by states)."""
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").where("l_linenumber <= 2").dropDuplicates()
    pairs = rows.where("l_linenumber = 1").alias("a").join(rows.where("l_linenumber = 2").alias("b"), ["l_orderkey", "l_linestatus"])
    return pairs.select("l_orderkey", F.sha2(F.concat_ws("|", "a.l_returnflag", "b.l_returnflag"), 256).alias("combination")).dropDuplicates()


@query("""WITH h AS (SELECT l_suppkey, min(l_orderkey) AS header FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l.l_suppkey, CASE WHEN header IS NULL THEN 'unmapped' WHEN l_orderkey < header THEN 'preamble' WHEN l_orderkey = header THEN 'header' ELSE 'record' END AS disposition, count(*) AS n FROM lineitem l LEFT JOIN h ON h.l_suppkey = l.l_suppkey GROUP BY 1, 2""")
def row_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a table's rows: before its header, the header, records after it, or no mapping at all."""
    rows = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("heads"))
    header = rows.where("heads > 0").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("header"))
    at = F.col("l_orderkey")
    named = F.when(F.col("header").isNull(), "unmapped").when(at < F.col("header"), "preamble").when(at == F.col("header"), "header").otherwise("record")
    return rows.join(header, "l_suppkey", "left").groupBy("l_suppkey", named.alias("disposition")).agg(F.sum("n").alias("n"))


@query("SELECT o_orderkey, c_mktsegment AS segment, n_name AS nation, o_orderpriority AS priority FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def path_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values addressed by paths from the root or from an item of nested records."""
    t = Tables(spark, sf_dir)
    nested = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    customer = F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.col("n_name").alias("name")).alias("nation"))
    rows = nested.select("o_orderkey", F.struct(customer.alias("customer")).alias("root"), F.struct(F.col("o_orderpriority").alias("priority")).alias("item"))
    paths = {"segment": "$root.customer.segment", "nation": "$root.customer.nation.name", "priority": "$item.priority"}
    return rows.select("o_orderkey", *(C.at_path(p).alias(n) for n, p in paths.items()))


@query("""SELECT l_orderkey, l_linenumber, 'fact_' || substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'), CAST(round(l_extendedprice * 100) AS BIGINT))), 1, 32) AS fact_id FROM lineitem""")
def fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from the eight fields that make a fact what it is."""
    day, cents = F.date_format("l_shipdate", "yyyy-MM-dd"), F.round(F.col("l_extendedprice") * 100).cast("long")
    fields = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")] + [day, cents.cast("string")]
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("fact_"), F.substring(F.sha2(F.concat_ws("|", *fields), 256), 1, 32)).alias("fact_id"))


@query("""SELECT doc_id, source, lang FROM documents WHERE source IN (SELECT max(source) FROM documents) AND (lang IS NULL OR lang = 'en')""")
def scoped_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of one scope without their payload; an entry without a workspace belongs to any."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "source", "lang")
    return docs.join(docs.agg(F.max("source").alias("source")), "source", "left_semi").where("lang IS NULL OR lang = 'en'").select("doc_id", "source", "lang")


@query("""SELECT user_id, CASE WHEN count(*) FILTER (value > 100) > 0 THEN 'changed' ELSE 'no_op' END AS status, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (value > 100), '') AS changed FROM events GROUP BY 1""")
def lifecycle_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that an operation changed, sorted and once each."""
    changed = F.array_sort(F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))))
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(F.when(F.size(changed) > 0, "changed").otherwise("no_op").alias("status"), F.array_join(changed, ",").alias("changed"))


@query("""SELECT c_custkey, CASE WHEN o.direct > 0 THEN 'direct' WHEN o.other > 0 THEN 'supplemental' ELSE 'missing' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS direct, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS other FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def supplemental_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements met directly, by references restored because they are eligible, or not at all."""
    t = Tables(spark, sf_dir)
    eligible = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)
    refs = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("direct"), F.count_if(eligible).alias("other"))
    status = F.when(F.col("direct") > 0, "direct").when(F.col("other") > 0, "supplemental").otherwise("missing")
    return t.customer.select("c_custkey").join(refs, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("""WITH d AS (SELECT r_name, unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS obligation, r_regionkey FROM region), c AS (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT r_name, obligation, coalesce(n, 0) AS facts, CASE WHEN n IS NULL THEN 'unmet' ELSE 'assembled' END AS status FROM d LEFT JOIN c ON n_regionkey = r_regionkey AND c_mktsegment = obligation""")
def case_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every obligation of every domain, with the facts that answer it; domains without facts stay."""
    t = Tables(spark, sf_dir)
    obligations = F.explode(F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])))
    demands = t.region.select("r_name", "r_regionkey", obligations.alias("obligation"))
    facts = t.customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("obligation")).agg(F.count("*").alias("n"))
    facts = facts.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), "obligation").agg(F.sum("n").alias("n"))
    return demands.join(facts, ["r_regionkey", "obligation"], "left").select("r_name", "obligation", F.coalesce("n", F.lit(0)).alias("facts"), F.when(F.col("n").isNull(), "unmet").otherwise("assembled").alias("status"))


@query("""SELECT CASE WHEN n >= 5 THEN 'table' WHEN n >= 2 THEN 'list' ELSE 'text' END AS decision, count(*) AS documents, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(kinds) AS BIGINT) AS kinds FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1) GROUP BY 1""")
def projection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of documents added up by the decision taken on each."""
    own = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("kinds"))
    decision = F.when(F.col("n") >= 5, "table").when(F.col("n") >= 2, "list").otherwise("text")
    return own.groupBy(decision.alias("decision")).agg(F.count("*").alias("documents"), F.sum("n").alias("rows"), F.sum("kinds").alias("kinds"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'review' WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 200000 THEN 'accept_exact' WHEN o_orderpriority = '1-URGENT' THEN 'accept_structural' WHEN o_orderstatus = 'F' AND o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'accept_hybrid' WHEN o_totalprice < 20000 THEN 'reject' ELSE 'unresolved' END AS terminal FROM orders""")
def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals in order of priority; the first that speaks decides."""
    urgent, done = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F"
    signals = [
        (F.col("o_orderstatus") == "P", "review"),
        (urgent & (F.col("o_totalprice") > 200000), "accept_exact"),
        (urgent, "accept_structural"),
        (done & F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "accept_hybrid"),
        (F.col("o_totalprice") < 20000, "reject"),
    ]
    return Tables(spark, sf_dir).orders.select("o_orderkey", C.first_of(signals, "unresolved").alias("terminal"))


@query("""WITH g AS (SELECT o_custkey AS id, 'source' AS kind, 'REQUIRED' AS level FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey, 'declaration', CASE WHEN c_acctbal < 0 THEN 'REQUIRED' ELSE 'ADVISORY' END FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT kind, level, count(*) AS requests FROM g GROUP BY 1, 2""")
def gap_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of two origins, each asked once, by kind and level."""
    t = Tables(spark, sf_dir)
    sources = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.lit("source").alias("kind"), F.lit("REQUIRED").alias("level"))
    level = F.when(F.col("c_acctbal") < 0, "REQUIRED").otherwise("ADVISORY")
    declared = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit("declaration").alias("kind"), level.alias("level"))
    return sources.unionByName(declared).dropDuplicates().groupBy("kind", "level").agg(F.count("*").alias("requests"))


@query("""SELECT k AS event_type, coalesce(n, 0) AS facts FROM (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS k) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON event_type = k""")
def evidence_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every category, those without any included."""
    kinds = spark.createDataFrame([(k,) for k in ("click", "error", "purchase", "refund", "signup", "view")], "event_type string")
    found = Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count("*").alias("n"))
    return kinds.join(found, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("facts"))


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'unresolved' WHEN low >= 2 THEN 'accept' ELSE 'reject' END AS decision FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_quantity) AS low FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def external_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposal is accepted if all its evidence holds, rejected if some doesn't, open if there is none."""
    t = Tables(spark, sf_dir)
    evidence = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_quantity").alias("low"), F.count("*").alias("n"))
    decision = F.when(F.col("n").isNull(), "unresolved").when(F.col("low") >= 2, "accept").otherwise("reject")
    return t.orders.select("o_orderkey").join(evidence, "o_orderkey", "left").select("o_orderkey", decision.alias("decision"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 49 THEN 'quantity_range' END, CASE WHEN l_discount >= 0.095 THEN 'discount_range' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'status_conflict' END) AS errors FROM lineitem""")
def fact_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that a fact breaks, not only the first."""
    checks = {"quantity_range": F.col("l_quantity") <= 49, "discount_range": F.col("l_discount") < 0.095, "status_conflict": ~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))}
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.array_join(C.failed(checks), ",").alias("errors"))


@query("""SELECT o_orderkey AS id, NULL::BIGINT AS parent, 0 AS depth FROM orders UNION ALL SELECT o_orderkey * 100 + l_linenumber, o_orderkey, 1 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def promoted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan queue of files and the members of those that are archives; members hold none, so there is one level."""
    t = Tables(spark, sf_dir)
    files = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"))
    archives = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("parent"))
    members = t.lineitem.select(F.col("l_orderkey").alias("parent"), "l_linenumber").dropDuplicates().join(archives, "parent")
    return files.unionByName(members.select((F.col("parent") * 100 + F.col("l_linenumber")).alias("id"), "parent", F.lit(1).alias("depth")))


@query("""SELECT l_orderkey, string_agg('[r' || l_linenumber || '] ' || l_returnflag || ' ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS view FROM lineitem GROUP BY 1""")
def reference_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as text, a line for each row behind its reference."""
    line = F.concat(F.lit("[r"), F.col("l_linenumber").cast("string"), F.lit("] "), "l_returnflag", F.lit(" "), F.col("l_partkey").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", line.alias("line"))))
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("view"))


@query("""SELECT p_partkey, (p_type IN ('ECONOMY', 'PROMO') AND p_size > 10) OR (p_brand = 'Brand#1' AND NOT p_name LIKE '%ring') AS review FROM part""")
def policy_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source has to be reviewed, from rules on its kind, size and origin."""
    kind = F.col("p_type").isin("ECONOMY", "PROMO") & (F.col("p_size") > 10)
    origin = (F.col("p_brand") == "Brand#1") & ~F.col("p_name").like("%ring")
    return Tables(spark, sf_dir).part.select("p_partkey", (kind | origin).alias("review"))


@query("""SELECT o_orderkey, CAST(len(l) AS INTEGER) AS attributes, array_to_string(l, ';') AS node FROM (SELECT o_orderkey, list_sort([ 'priority=' || o_orderpriority, 'status=' || o_orderstatus ] || list_transform(coalesce(f, []), lambda x: 'flag' || x)) AS l FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT l_linenumber || '=' || l_returnflag) AS f FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1) ON l_orderkey = o_orderkey)""")
def node_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an element (its own attributes, and one for each line) folded into a node with a map of attributes."""
    t = Tables(spark, sf_dir)
    own = t.orders.select("o_orderkey", F.inline(F.array(F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("value")))))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("flag"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_returnflag").alias("value"))
    lines = lines.join(t.orders, "o_orderkey", "left_semi")
    return C.nodes(own.unionByName(lines), "o_orderkey", "name", "value").select("o_orderkey", F.size("attributes").alias("attributes"), F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("node"))
