"""Queries of literal normalizers, detectors and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals as L
from .base import Tables, query

_PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS VARCHAR)"


@query(f"""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN {_PRICE} WHEN 2 THEN {_PRICE} WHEN 3 THEN {_PRICE} WHEN 4 THEN '-' || {_PRICE} WHEN 5 THEN '+' || {_PRICE}
WHEN 6 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || '.5,0' ELSE l_returnflag END AS value FROM lineitem""")
def decimal_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as a column writes them: plain, grouped by commas, dots or no-break spaces, signed; two separators out of order and words stay."""
    rows = Tables(spark, sf_dir).lineitem
    plain, commas = L.money_text(F.col("l_extendedprice")), F.format_number(F.col("l_extendedprice").cast("decimal(20,2)"), 2)
    n = F.col("l_linenumber")
    literal = (
        F.when(n == 1, plain).when(n == 2, commas).when(n == 3, F.translate(commas, ",.", ".,")).when(n == 4, F.concat(F.lit("-"), F.translate(commas, ",.", "\u00a0,")))
        .when(n == 5, F.concat(F.lit("+"), F.translate(plain, ".", ","))).when(n == 6, F.concat(F.floor("l_extendedprice").cast("string"), F.lit(".5,0"))).otherwise(F.col("l_returnflag"))
    )
    return rows.select("l_orderkey", "l_linenumber", L.decimal_literal(literal).alias("value"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '31' || strftime(o_orderdate, '.02.%Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS value FROM orders""")
def date_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders year first or day first; days that no February has and slashed dates stay."""
    day = lambda form: F.date_format("o_orderdate", form)
    n = F.col("o_orderkey") % 4
    literal = F.when(n == 0, day("yyyy-MM-dd")).when(n == 1, day("dd.MM.yyyy")).when(n == 2, F.concat(F.lit("31.02."), day("yyyy"))).otherwise(day("MM/dd/yyyy"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", L.date_literal(literal).alias("value"))


@query("""SELECT c_custkey, kind, count(*) AS n FROM (SELECT c_custkey, 'decimal' AS kind FROM customer UNION ALL SELECT c_custkey, 'currency' FROM customer UNION ALL SELECT c_custkey, 'isin' FROM customer
UNION ALL SELECT o_custkey, 'date' FROM orders UNION ALL SELECT c_custkey, '' FROM customer) GROUP BY 1, 2""")
def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cells of a customer's rows may be: balances, order dates, codes of three letters, twelve-character codes, names."""
    t = Tables(spark, sf_dir)
    code = F.concat(F.lit("US"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), (F.col("c_custkey") % 10).cast("string"))
    cells = t.customer.select("c_custkey", F.explode(F.array(L.money_text(F.col("c_acctbal")), F.substring("c_mktsegment", 1, 3), code, F.lower("c_name"))).alias("cell"))
    dates = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("cell"))
    return cells.unionByName(dates).groupBy("c_custkey", F.concat_ws(",", L.value_kinds(F.col("cell"))).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand, CASE WHEN bool_or(c) AND bool_or(d) THEN 'ambiguous' WHEN bool_or(c) THEN 'comma_dot' WHEN bool_or(d) THEN 'dot_comma' ELSE 'none' END AS convention FROM (SELECT p_brand, p_partkey % 40 = 0 AS c, p_partkey % 60 = 1 AS d FROM part) GROUP BY p_brand""")
def numeric_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouping convention of a column of literals."""
    key = F.col("p_partkey")
    cell = F.when(key % 40 == 0, "1,234.50").when(key % 60 == 1, "1.234,50").otherwise("12")
    return Tables(spark, sf_dir).part.select("p_brand", cell.alias("cell")).groupBy("p_brand").agg(L.numeric_convention(F.col("cell")).alias("convention"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal > 0 THEN 'positive' WHEN c_acctbal = 0 THEN 'zero' ELSE 'not_applicable' END AS sign, CAST(CAST(c_acctbal AS DECIMAL(20,2)) AS VARCHAR) AS amount FROM customer")
def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).customer.select("c_custkey", L.sign(F.col("c_acctbal")).alias("sign"), L.money_text(F.col("c_acctbal")).alias("amount"))


@query("""SELECT p_partkey, trim(upper(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name FROM part""")
def comparable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.select("p_partkey", L.comparable(F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("   ")), F.lit(" "))).alias("name"))


@query("""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS slug, regexp_replace(lower(text), '[^0-9a-zа-яё]+', '', 'g') AS folded FROM benchmark""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).benchmark.select("item_id", L.slug(F.col("text")).alias("slug"), L.alnum_fold(F.col("text")).alias("folded"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS n, regexp_extract(text, '[0-9]+(?:[.,][0-9]+)*') AS first FROM documents WHERE regexp_matches(text, '[0-9]')""")
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).documents.select("doc_id", L.numeric_tokens(F.col("text")).alias("tokens")).where("size(tokens) > 0")
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n"), F.get("tokens", F.lit(0)).alias("first"))


@query("SELECT doc_id, regexp_matches(text, '5[ .,]*5[ .,]*5') AS found FROM documents")
def spaced_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits in a text with optional separators between them."""
    return Tables(spark, sf_dir).documents.withColumn("p", L.spaced_digits_pattern(F.lit("555"))).select("doc_id", F.expr("text rlike p").alias("found"))


@query(r"""SELECT doc_id, kind, value FROM (
SELECT doc_id, 'mail' AS kind, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]'))) AS value FROM documents UNION ALL
SELECT doc_id, 'phone', unnest(list_distinct(regexp_extract_all(text, '\([0-9]{3}\) [0-9]{3}-[0-9]{4}'))) FROM documents UNION ALL
SELECT doc_id, 'ip', unnest(list_distinct(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))) FROM documents)""")
def metadata_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts found by several patterns, once a document, kind and value; one scan finds them all."""
    patterns = {"mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]", "phone": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"}

    def facts(kind: str, pattern: str) -> Column:
        values = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return Tables(spark, sf_dir).documents.select("doc_id", F.inline(F.concat(*(facts(k, p) for k, p in patterns.items()))))


@query("""SELECT doc_id, substr(sha256(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(lang, ''), coalesce(source, ''))), 1, 16) AS digest, 'doc_' || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END || '_' || substr(sha256(text), 1, 12) AS ref FROM documents""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", L.stable_digest(F.col("doc_id"), F.col("lang"), F.col("source")).alias("digest"), L.document_ref(F.col("doc_id"), F.col("text")).alias("ref"))


@query("""SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","note":null}') AS fingerprint FROM nation""")
def json_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of JSON with sorted keys and nulls."""
    row = L.canonical_json(name=F.col("n_name"), note=F.lit(None).cast("string"), key=F.col("n_nationkey"))
    return Tables(spark, sf_dir).nation.select("n_nationkey", F.sha2(row, 256).alias("fingerprint"))


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) + 64 AS BIGINT) AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", L.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("""SELECT user_id, CASE WHEN p >= 15 THEN 'resident' WHEN p + a = 30 THEN 'not_resident' ELSE 'insufficient' END AS status FROM (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE event_type <> 'error') AS p, count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE event_type = 'error') AS a FROM events GROUP BY 1)""")
def residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, away = F.col("ts").cast("date"), F.col("event_type") == "error"
    days = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.countDistinct(F.when(~away, day)).alias("p"), F.countDistinct(F.when(away, day)).alias("a"))
    return days.select("user_id", L.residency(F.col("p"), F.col("p") + F.col("a"), F.lit(30), least=15).alias("status"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS dated, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) AS amount, CAST(CAST(round(CAST(o_totalprice AS DECIMAL(20,2)), 0) AS DECIMAL(20,0)) AS VARCHAR) AS whole, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' END AS code FROM orders""")
def xml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return Tables(spark, sf_dir).orders.select(
        "o_orderkey", L.xml_value(F.col("o_orderdate"), "date").alias("dated"), L.xml_value(price, "money").alias("amount"), L.xml_value(price, "money_whole").alias("whole"), L.xml_value(F.col("o_orderstatus"), "enum", {"F": "1", "O": "2"}).alias("code")
    )


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation ' || n_name || ' of region ' || n_regionkey ELSE 'plain' || chr(10) || n_name || chr(10) || n_regionkey END AS prompt FROM nation")
def template_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.when(F.col("n_nationkey") % 2 == 0, "Nation {{name}} of region {{region}}").otherwise("plain")
    return Tables(spark, sf_dir).nation.select("n_nationkey", L.substitute(template, name=F.col("n_name"), region=F.col("n_regionkey").cast("string")).alias("prompt"))
