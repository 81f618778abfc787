"""Queries of sources and sinks, each on contents built from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import containers, parsers, store, transcripts
from .base import Tables, query


@query("SELECT c_custkey // 500 AS file, CAST(row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) AS INTEGER) AS row, CAST(c_custkey AS VARCHAR) || '/' || c_name AS cells FROM customer")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files of 500 customers each, strictly parsed; the header is row 0."""
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(';"'), "c_name", F.lit('"'))
    bodies = Tables(spark, sf_dir).customer.groupBy(F.expr("c_custkey div 500").alias("file")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines"))
    files = bodies.select("file", F.concat(F.lit("key;name\n"), F.concat_ws("\n", F.transform("lines", lambda x: x["line"]))).alias("content"))
    rows = parsers.read_as(files, "csv", "file")
    return rows.where("row > 0").select("file", "row", F.array_join("cells", "/").alias("cells"))


@query("""SELECT r_regionkey, v.ordinal, v.type, v.node_path, v.value FROM region, LATERAL (SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'start', '/region', NULL), (1, 'attribute', '/region', CAST(r_regionkey AS VARCHAR)), (2, 'start', '/region/name', NULL), (3, 'text', '/region/name', r_name), (4, 'end', '/region/name', NULL), (5, 'end', '/region', NULL)) t(ordinal, type, node_path, value)) v""")
def xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML written by the sink, read back as ordered events."""
    xml = store.xml_rows(F.struct(F.col("r_regionkey").alias("_key"), F.col("r_name").alias("name")), "region")
    rows = parsers.read_as(Tables(spark, sf_dir).region.select("r_regionkey", xml.alias("content")), "xml", "r_regionkey")
    return rows.select("r_regionkey", "ordinal", "type", "node_path", "value")


@query("""SELECT n_nationkey, '<nation>' || chr(10) || '    <key>' || n_nationkey || '</key>' || chr(10) || '    <name>' || n_name || '</name>' || chr(10) || '</nation>' AS xml FROM nation""")
def xml_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).nation.select("n_nationkey", store.xml_rows(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), "nation").alias("xml"))


@query("""SELECT s_suppkey // 50 AS page, CAST(dense_rank() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) - 1 AS INTEGER) AS row, CAST(u.col AS INTEGER) AS col, CASE u.col WHEN 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END AS text FROM supplier, (VALUES (0), (1)) u(col)""")
def html_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a table of 50 suppliers each; empty cells are dropped, cells left open are closed."""
    row = F.concat(F.lit("<tr><td>"), F.col("s_suppkey").cast("string"), F.lit("</td><td> </td><td>"), "s_name", F.lit("</tr>"))
    rows = Tables(spark, sf_dir).supplier.groupBy(F.expr("s_suppkey div 50").alias("page")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("rows"))
    pages = rows.select("page", F.concat(F.lit("<html><style>td{}</style><table>"), F.concat_ws("\n", F.transform("rows", lambda x: x["row"])), F.lit("</table>")).alias("content"))
    return parsers.read_as(pages, "html", "page").select("page", "row", "col", "text")


@query("""SELECT page_id, CASE WHEN lower(left(html, 9)) = '<!doctype' OR left(html, 5) = '<html' THEN 'html' ELSE 'htm' END AS format, CASE WHEN left(html, 9) IN ('<!doctype', '<!DOCTYPE') OR left(html, 5) = '<html' THEN 'content' ELSE 'metadata' END AS basis, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages""")
def container_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = containers.container(F.col("html").cast("binary"), F.lit("htm"))
    return Tables(spark, sf_dir).pages.select("page_id", found["format"].alias("format"), found["basis"].alias("basis"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query("""SELECT conv_id, string_agg('[' || turn || '.0-' || (turn + 1) || '.0] ' || role || ': ' || trim(text), chr(10) ORDER BY turn) AS rendered, count(*) AS segments FROM conversations GROUP BY conv_id""")
def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider JSON built from conversations, normalized and rendered."""
    segment = F.struct("turn", F.struct(F.col("text"), F.col("turn").cast("string").alias("start"), (F.col("turn") + 1).cast("string").alias("end"), F.col("role").alias("speaker")).alias("s"))
    payloads = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["s"]).alias("segments"))).alias("payload"))
    found = payloads.select("conv_id", transcripts.normalized(F.col("payload")).alias("t"))
    return found.select("conv_id", transcripts.rendered(F.col("t.segments")).alias("rendered"), F.size("t.segments").cast("long").alias("segments"))


@query("""SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def partition_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition of a written table replaced; the others stay."""
    rows = Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    path = store.shared_folder(spark)
    store.replace_partitions(rows, path, "c_mktsegment")
    store.replace_partitions(rows.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.lit(0.0)), path, "c_mktsegment")
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query("""SELECT event_id FROM events WHERE event_type <> 'error' OR ts > TIMESTAMP '2024-01-20 00:00:00'""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without an expiry, and those whose expiry is still to come."""
    expires = F.when(F.col("event_type") == "error", F.col("ts").cast("timestamp_ntz"))
    return store.unexpired(Tables(spark, sf_dir).events, expires, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")
