"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import money
from ..operators import aggregates as A
from ..operators.routing import cascade
from .base import Tables, query


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DECIMAL(30,2)) AS amount, count(*) AS members, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL""")
def money_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum(money(F.col("l_extendedprice"))).cast("decimal(30,2)").alias("amount"), F.count("*").alias("members"), F.countDistinct("l_orderkey").alias("orders"))


@query("""SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS same_flag, count(DISTINCT l_linestatus) = 1 AS same_status FROM lineitem GROUP BY l_orderkey""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = A.all_equal(F.col("l_returnflag"), F.col("l_linestatus"))
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(flag.alias("same_flag"), status.alias("same_status"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicates(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


_BASE = """SELECT o_custkey, sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS category, sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS other, sum(CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS exempt FROM orders GROUP BY o_custkey"""


@query(f"""SELECT o_custkey, CAST(category + other AS DECIMAL(30,2)) AS total, CAST(category + other - exempt AS DECIMAL(30,2)) AS taxable, CASE WHEN exempt > category THEN 'exempt_exceeds' ELSE 'ok' END AS guard FROM ({_BASE})""")
def income_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """total, taxable and a guard by group, in exact decimals."""
    price = money(F.col("o_totalprice"))
    part = lambda condition, name: F.sum(F.when(condition, price).otherwise(0)).alias(name)
    sums = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(part(F.col("o_orderstatus") != "P", "category"), part(F.col("o_orderstatus") == "P", "other"), part(F.col("o_orderpriority") == "5-LOW", "exempt"))
    total = F.col("category") + F.col("other")
    return sums.select("o_custkey", total.cast("decimal(30,2)").alias("total"), (total - F.col("exempt")).cast("decimal(30,2)").alias("taxable"), F.when(F.col("exempt") > F.col("category"), "exempt_exceeds").otherwise("ok").alias("guard"))


@query("""WITH s AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(20,2))) FILTER (WHERE o_orderstatus = 'F') AS due, sum(CAST(o_totalprice AS DECIMAL(20,2))) FILTER (WHERE o_orderstatus = 'O') AS paid FROM orders GROUP BY 1)
SELECT o_custkey, CAST(greatest(coalesce(due, 0) - coalesce(paid, 0), 0) AS DECIMAL(30,2)) AS payable, CAST(greatest(coalesce(paid, 0) - coalesce(due, 0), 0) AS DECIMAL(30,2)) AS refundable, CASE WHEN coalesce(due, 0) > coalesce(paid, 0) THEN 'pay' WHEN coalesce(due, 0) < coalesce(paid, 0) THEN 'refund' ELSE 'even' END AS outcome FROM s""")
def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = money(F.col("o_totalprice"))
    sums = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(*(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, price)), F.lit(0)).alias(n) for s, n in (("F", "due"), ("O", "paid"))))
    due, paid = F.col("due"), F.col("paid")
    return sums.select("o_custkey", F.greatest(due - paid, F.lit(0)).cast("decimal(30,2)").alias("payable"), F.greatest(paid - due, F.lit(0)).cast("decimal(30,2)").alias("refundable"), cascade((due > paid, "pay"), (due < paid, "refund"), otherwise="even").alias("outcome"))


@query("SELECT role AS key, count(DISTINCT conv_id) AS n FROM conversations GROUP BY role")
def dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the values of a multi-valued dimension, each once a value."""
    records = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return A.member_counts(records, F.col("roles"))


@query("""SELECT coalesce(p_brand, 'all') AS brand, coalesce(p_type, 'all') AS type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())""")
def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Tables(spark, sf_dir).part
    return part.groupingSets([["p_brand", "p_type"], ["p_brand"], []], "p_brand", "p_type").agg(F.count("*").alias("n")).select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce("p_type", F.lit("all")).alias("type"), "n")


@query("SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def terminal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.zero_filled_counts(Tables(spark, sf_dir).orders, "o_orderstatus", ["F", "O", "P", "X"])


@query("SELECT l AS level, count(o_orderkey) AS n FROM (VALUES ('critical'), ('major'), ('minor'), ('none')) v(l) LEFT JOIN (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 300000 THEN 'major' ELSE 'minor' END AS lv FROM orders) ON lv = l GROUP BY l")
def criticality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = cascade((F.col("o_orderpriority") == "1-URGENT", "critical"), ((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_totalprice") > 300000), "major"), otherwise="minor")
    return A.zero_filled_counts(Tables(spark, sf_dir).orders.select(level.alias("level")), "level", ["critical", "major", "minor", "none"])


@query("""SELECT source, count(*) AS documents, count(DISTINCT sha256(text)) AS contents, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (WHERE n_chars < 200) AS short, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY source""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("source", "n_chars", F.sha2("text", 256).alias("sha")).groupBy("source").agg(
        F.count("*").alias("documents"), F.countDistinct("sha").alias("contents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 200).alias("short"), F.max("n_chars").alias("longest")
    )


@query("""SELECT user_id, count(*) AS chunks, count(*) FILTER (WHERE event_type = 'error') AS failed, CAST(sum(CAST(value AS DECIMAL(20,2))) FILTER (WHERE event_type <> 'error') AS DECIMAL(30,2)) AS tokens, max(CAST(value AS DECIMAL(20,2))) AS longest, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM events GROUP BY user_id""")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, failed = money(F.col("value")), F.col("event_type") == "error"
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(
        F.count("*").alias("chunks"), F.count_if(failed).alias("failed"), F.sum(F.when(~failed, value)).cast("decimal(30,2)").alias("tokens"), F.max(value).alias("longest"), F.when(F.count_if(failed) == 0, "complete").otherwise("incomplete").alias("status")
    )


@query("""SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN text LIKE '%@%' THEN 'mail' END], lambda x: x IS NOT NULL)) AS code FROM documents) GROUP BY code""")
def error_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array_compact(F.array(F.when(F.col("n_chars") < 100, F.lit("short")), F.when(F.col("lang") != "en", F.lit("foreign")), F.when(F.col("text").contains("@"), F.lit("mail"))))
    return A.member_counts(Tables(spark, sf_dir).documents, codes, "code")


@query("""SELECT event_id, CAST(sum(CAST(value AS DECIMAL(20,2))) OVER w AS DECIMAL(30,2)) AS spent, sum(CAST(value AS DECIMAL(20,2))) OVER w <= 1500 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = Tables(spark, sf_dir).events.select("event_id", "user_id", "ts", money(F.col("value")).alias("cost"))
    return A.running_budget(costs, "user_id", ["ts", "event_id"], "cost", F.lit(1500)).select("event_id", F.col("spent").cast("decimal(30,2)").alias("spent"), "within")


@query("""SELECT doc_id, CAST(ceil(CAST(n_chars AS DECIMAL(18,0)) * 37 / 100.0 ) AS BIGINT) AS micro FROM documents""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost in millionths, rounded up: characters at 0.37 millionths each."""
    return Tables(spark, sf_dir).documents.select("doc_id", (A.ceil_cost(F.col("n_chars"), F.lit("0.0000003700"), 6) * 1_000_000).cast("long").alias("micro"))


@query("""SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DECIMAL(30,2)) AS total, CAST(count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INTEGER) IS NULL) AS BIGINT) AS unreported FROM events GROUP BY event_type""")
def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.sum(money(F.col("value"))).cast("decimal(30,2)").alias("total"), F.count_if(k.isNull()).alias("unreported"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax IS NULL OR l_discount IS NULL THEN 'operand_missing' WHEN CAST(l_tax AS DECIMAL(20,2)) + CAST(l_discount AS DECIMAL(20,2)) = CAST(0.10 AS DECIMAL(20,2)) THEN 'reconciled' ELSE 'mismatch' END AS status FROM lineitem""")
def operand_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operands that add up to a printed value (here 0.10)."""
    tax, discount = money(F.col("l_tax")), money(F.col("l_discount"))
    status = cascade((tax.isNull() | discount.isNull(), "operand_missing"), (tax + discount == F.lit("0.10").cast("decimal(20,2)"), "reconciled"), otherwise="mismatch")
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"))


_TOKENS = "SELECT {g} AS g, unnest(string_split(lower({t}), ' ')) AS w FROM {f}"


@query(f"""WITH l AS (SELECT g, w, count(*) AS l FROM ({_TOKENS.format(g="lang", t="text", f="documents WHERE doc_id % 2 = 0")}) GROUP BY ALL), r AS (SELECT g, w, count(*) AS r FROM ({_TOKENS.format(g="lang", t="text", f="documents WHERE doc_id % 2 = 1")}) GROUP BY ALL)
SELECT g, CAST(sum(least(coalesce(l, 0), coalesce(r, 0))) AS BIGINT) AS common, CAST(sum(coalesce(l, 0)) AS BIGINT) AS n_left, CAST(sum(coalesce(r, 0)) AS BIGINT) AS n_right FROM l FULL JOIN r USING (g, w) GROUP BY g""")
def multiset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token multisets of even and odd documents by language: what they share."""
    tokens = Tables(spark, sf_dir).documents.select("doc_id", F.col("lang").alias("g"), F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return A.multiset_overlap(tokens.where("doc_id % 2 = 0"), tokens.where("doc_id % 2 = 1"), "g", "w")


@query("""SELECT doc_id, n_chars >= 100 AND n_chars <= 10000 AND lang = 'en' AS passed, concat_ws(',', CASE WHEN NOT n_chars <= 10000 THEN 'bounded' END, CASE WHEN NOT lang = 'en' THEN 'english' END, CASE WHEN NOT n_chars >= 100 THEN 'filled' END) AS failed FROM documents""")
def gate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", *A.gates({"filled": F.col("n_chars") >= 100, "bounded": F.col("n_chars") <= 10000, "english": F.col("lang") == "en"}))


@query("""SELECT l_suppkey, l_returnflag, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS elements, min(l_linenumber) <> max(l_linenumber) AS conflict FROM lineitem GROUP BY ALL""")
def requirement_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = A.union_of_arrays(Tables(spark, sf_dir).lineitem, ["l_suppkey", "l_returnflag"], "l_linestatus", "l_linenumber")
    return merged.withColumn("elements", F.array_join("elements", ","))


@query("""SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS canonical, doc_id <> first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS is_copy FROM documents""")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content; hashes are aggregated before the join, so large groups of copies don't meet in a window."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("canonical"))
    return docs.join(first, "sha").select("doc_id", "canonical", (F.col("doc_id") != F.col("canonical")).alias("is_copy"))


@query("""SELECT source, round(avg(CASE WHEN n_chars < 300 THEN 1.0 ELSE 0.0 END), 6) AS density, avg(CASE WHEN n_chars < 300 THEN 1.0 ELSE 0.0 END) > 0.1 AS sparse FROM documents GROUP BY source""")
def empty_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg((F.col("n_chars") < 300).cast("double"))
    return Tables(spark, sf_dir).documents.groupBy("source").agg(F.round(share, 6).alias("density"), (share > 0.1).alias("sparse"))


@query("""SELECT DISTINCT ON (event_type, user_id) event_type, user_id, event_id FROM events ORDER BY event_type, user_id, event_id""")
def fact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("""SELECT l_orderkey, count(*) AS present, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(l_quantity AS BIGINT)) * 100 / sum(sum(CAST(l_quantity AS BIGINT))) OVER (PARTITION BY l_orderkey % 100) AS DOUBLE) AS share FROM lineitem GROUP BY l_orderkey""")
def group_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.count("*").alias("present"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    own = sums.withColumn("k", F.col("l_orderkey") % 100)
    totals = own.groupBy("k").agg(F.sum("quantity").alias("total"))
    return own.join(totals, "k").select("l_orderkey", "present", "quantity", (F.col("quantity") * 100 / F.col("total")).alias("share"))
