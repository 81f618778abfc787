"""Queries of filters, paging, semi-joins and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import money, stable_digest
from ..operators import selection as S
from ..operators.routing import cascade, reasons
from .base import Tables, query


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS fact_date, CAST(o_totalprice AS DECIMAL(20,2)) AS amount FROM orders
WHERE o_custkey BETWEEN 1 AND 400 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' ORDER BY fact_date NULLS LAST, o_orderstatus, o_orderkey""")
def case_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("fact_date"), money(F.col("o_totalprice")).alias("amount"))
    return S.scoped(facts, o_custkey=(1, 400), fact_date=("1996-01-01", "1998-12-31")).orderBy(F.asc_nulls_last("fact_date"), "o_orderstatus", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 37")
def case_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scoped(Tables(spark, sf_dir).orders, o_custkey=37).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def type_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scoped(Tables(spark, sf_dir).orders, o_orderstatus="F").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scoped(Tables(spark, sf_dir).orders, o_orderkey=77).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey = 42")
def asset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scoped(Tables(spark, sf_dir).lineitem, l_partkey=42).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-08 00:00:00'")
def period_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = [F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz") for d in ("05", "08")]
    return Tables(spark, sf_dir).events.where(F.col("ts").cast("timestamp_ntz").between(*span)).select("event_id", "event_type")


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_brand = 'Brand#7' OR p_brand = 'Brand#9' ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 10""")
def domain_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of filtered parts by a total order; the page is the feature."""
    found = S.scoped(Tables(spark, sf_dir).part, p_brand=["Brand#7", "Brand#9"]).select("p_partkey", "p_name", "p_size")
    return S.page(found, [F.desc("p_size"), F.asc("p_partkey")], limit=25, offset=10)


@query("SELECT c_custkey, c_name FROM customer WHERE upper(trim(c_mktsegment)) = 'BUILDING' AND c_nationkey IN (1, 2, 3, 4) AND c_acctbal BETWEEN 0 AND 5000")
def conjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = S.normalized_filter("  building ")
    rows = Tables(spark, sf_dir).customer.where(F.upper(F.trim("c_mktsegment")) == segment)
    return S.scoped(rows, c_nationkey=[1, 2, 3, 4], c_acctbal=(0, 5000), c_name=None).select("c_custkey", "c_name")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup') AND CAST(json_extract(props, '$.k') AS INTEGER) >= 90")
def typed_record_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scoped(Tables(spark, sf_dir).events, event_type=["purchase", "signup"])
    return rows.where(F.get_json_object("props", "$.k").cast("int") >= 90).select("event_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def coverage_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    urgent = S.scoped(t.orders, o_orderstatus="P", o_orderpriority="1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def excluded_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return S.without_stale(t.documents.select("doc_id"), t.labels, "doc_id")


@query("""SELECT s_suppkey, n_name AS provenance, substr(sha256(concat_ws('|', CAST(s_suppkey AS VARCHAR), n_name)), 1, 16) AS digest
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def provenance_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    both = t.supplier.join(t.nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    return both.select("s_suppkey", F.col("n_name").alias("provenance"), stable_digest(F.col("s_suppkey"), F.col("n_name")).alias("digest"))


@query("""SELECT conv_id, min(text) FILTER (WHERE role = 'user') AS asked, min(text) FILTER (WHERE role = 'system') AS instructed,
array_to_string(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(list(role), x)), ',') AS missing FROM conversations GROUP BY conv_id""")
def role_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a record as an array of structs, projected to columns, with the roles that are missing."""
    turns = Tables(spark, sf_dir).conversations
    least = turns.groupBy("conv_id", "role").agg(F.min("text").alias("value"))
    roles = least.groupBy("conv_id").agg(F.collect_list(F.struct("role", F.lit("value").alias("status"), "value")).alias("roles"))
    value = S.role_values(F.col("roles"), ["user", "system"])
    return roles.select("conv_id", value["user"].alias("asked"), value["system"].alias("instructed"), F.concat_ws(",", S.missing_roles(F.col("roles"), ["assistant", "system", "user"])).alias("missing"))


@query("""SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_chars
FROM conversations WHERE role <> 'system'""")
def narrowed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept units with their text offsets rebased to what is kept."""
    kept = Tables(spark, sf_dir).conversations.where("role <> 'system'")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return kept.select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long").alias("offset_chars"))


@query("""SELECT page_id, CASE WHEN url IS NULL THEN 'blocked' WHEN length(url) > 60 THEN 'too_long' WHEN contains(url, '..') THEN 'traversal' WHEN url LIKE '/%' THEN 'absolute' ELSE 'accepted' END AS disposition,
concat_ws(',', CASE WHEN length(url) > 40 THEN 'long' END, CASE WHEN contains(url, '?') THEN 'query' END, CASE WHEN contains(url, '#') THEN 'fragment' END) AS reasons FROM pages""")
def name_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of member names: one disposition, and all reasons."""
    url = F.col("url")
    disposition = cascade((url.isNull(), "blocked"), (F.length(url) > 60, "too_long"), (url.contains(".."), "traversal"), (url.startswith("/"), "absolute"), otherwise="accepted")
    return Tables(spark, sf_dir).pages.select("page_id", disposition.alias("disposition"), reasons((F.length(url) > 40, "long"), (url.contains("?"), "query"), (url.contains("#"), "fragment")).alias("reasons"))


@query("""SELECT doc_id, CASE WHEN lang IS NULL THEN 'denied_scope' WHEN lang <> 'en' THEN 'denied_visibility' WHEN n_chars < 100 THEN 'blocked' WHEN quality = 0 THEN 'purged' WHEN quality IS NULL THEN 'pending' END AS error
FROM documents LEFT JOIN labels USING (doc_id)""")
def access_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first access check that a record fails."""
    t = Tables(spark, sf_dir)
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    checks = [(F.col("lang").isNull(), "denied_scope"), (F.col("lang") != "en", "denied_visibility"), (F.col("n_chars") < 100, "blocked"), (F.col("quality") == 0, "purged"), (F.col("quality").isNull(), "pending")]
    return S.access_error(rows, checks).select("doc_id", "error")


@query("""WITH lines AS (
SELECT r_regionkey AS top, 0 AS level, CAST(-1 AS INTEGER) AS mid, r_name AS label FROM region UNION ALL
SELECT n_regionkey, 1, n_nationkey, n_name FROM nation)
SELECT top, string_agg(repeat('  ', level) || label, chr(10) ORDER BY mid) AS rendered FROM lines GROUP BY top""")
def tree_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container tree as text, depth first: containers and their children, ordered and indented."""
    t = Tables(spark, sf_dir)
    lines = t.region.select(F.col("r_regionkey").alias("top"), F.lit(-1).alias("mid"), F.col("r_name").alias("line")).unionByName(t.nation.select(F.col("n_regionkey").alias("top"), F.col("n_nationkey").alias("mid"), F.concat(F.lit("  "), "n_name").alias("line")))
    return lines.groupBy("top").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("mid", "line"))), lambda x: x["line"])).alias("rendered"))
