"""Queries of stored texts and files: spans through blocks, documents by definition, pages of PDF, fuzzy fields, replayed journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, fuzzy, resolve
from ..sources import containers, office, parsers, pdf, store
from ..streaming import replay
from .base import Tables, query


@query("""WITH s AS (SELECT doc_id + CASE WHEN j = 4 THEN 1000000000 ELSE 0 END AS doc_id, doc_id * 10 + j AS span, (doc_id * 7919 * (j + 1)) % (length(text) + 1) AS start, (doc_id * 7919 * (j + 1)) % (length(text) + 1) + j * 2600 + 3 AS until, text, j
  FROM documents, (SELECT unnest(range(5)) AS j) WHERE text IS NOT NULL)
SELECT span, CASE WHEN j < 3 AND until <= length(text) THEN sha256(substr(text, start + 1, until - start)) END AS value_sha256,
CASE WHEN j = 4 THEN 'unknown' WHEN until > length(text) THEN 'out_of_range' WHEN j = 3 THEN 'changed' ELSE 'resolved' END AS status FROM s""")
def batch_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five spans of every document, of up to several blocks; one with a wrong checksum and one of an unknown document."""
    docs = Tables(spark, sf_dir).documents.where("text IS NOT NULL").select("doc_id", "text")
    index = store.saved(resolve.blocks(docs, "doc_id", "text"))
    each = docs.select("doc_id", F.char_length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    start = (F.col("doc_id") * 7919 * (F.col("j") + 1)) % (F.col("n") + 1)
    key = F.col("doc_id") + F.when(F.col("j") == 4, 1_000_000_000).otherwise(0)
    spans = each.select(key.alias("doc_id"), (F.col("doc_id") * 10 + F.col("j")).alias("span"), start.alias("start"), (start + F.col("j") * 2600 + 3).alias("until"), F.when(F.col("j") == 3, "not a checksum").alias("checksum"))
    found = resolve.resolved(index, spans, "doc_id", "span")
    return found.select("span", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "status")


_LINE = documents.Element(
    "line", "lineitem", "l_linenumber", ("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"),
    (documents.Field("number", "l_linenumber", attribute=True), documents.Field("part", "l_partkey"), documents.Field("price", "l_extendedprice", "money"), documents.Field("shipped", "l_shipdate", "date")), "l_orderkey", 1, 6,
)
_ORDER = documents.Element(
    "order", "orders", "o_orderkey", ("o_orderdate", "o_orderkey"), (documents.Field("id", "o_orderkey", attribute=True), documents.Field("status", "open_status", required=True), documents.Field("total", "o_totalprice", "money")), "o_custkey", children=(_LINE,),
)
CUSTOMER = documents.Element("customer", "customer", "c_custkey", ("c_custkey",), (documents.Field("segment", "c_mktsegment", attribute=True), documents.Field("name", "c_name", required=True)), children=(_ORDER,))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg('<line number="' || l_linenumber || '"><part>' || l_partkey || '</part><price>' || CAST(l_extendedprice AS DECIMAL(20,2)) || '</price><shipped>' || strftime(l_shipdate, '%d.%m.%Y') || '</shipped></line>', '' ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS xml FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, o_orderstatus = 'P' AS bare, coalesce(n, 0) = 0 AS few, coalesce(n, 0) > 6 AS many, o_orderdate, o_orderkey,
  '<order id="' || o_orderkey || '">' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE '<status>' || CASE WHEN o_orderstatus = 'O' THEN '<open> & unpaid' ELSE o_orderstatus END || '</status>' END || '<total>' || CAST(o_totalprice AS DECIMAL(20,2)) || '</total>' || coalesce(l.xml, '') || '</order>' AS xml FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
c AS (SELECT o_custkey, bool_or(bare) AS bare, bool_or(few) AS few, bool_or(many) AS many, string_agg(replace(xml, '<open> & unpaid', '&lt;open&gt; &amp; unpaid'), '' ORDER BY o_orderdate, o_orderkey) AS xml FROM o GROUP BY 1)
SELECT c_custkey, sha256('<customer segment="' || c_mktsegment || '"><name>' || c_name || '</name>' || coalesce(xml, '') || '</customer>') AS xml_sha256,
concat_ws(',', CASE WHEN few THEN '/customer/order/line:too_few' END, CASE WHEN many THEN '/customer/order/line:too_many' END, CASE WHEN bare THEN '/customer/order/status:missing' END) AS violations FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def defined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer by definition: orders by date, lines by number, escapes, missing values and bounds of repeats."""
    t = Tables(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "O", "<open> & unpaid").when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    found = documents.assembled(CUSTOMER, {"customer": t.customer, "orders": t.orders.withColumn("open_status", status), "lineitem": t.lineitem})
    return found.select("c_custkey", F.sha2(F.col("xml").cast("binary"), 256).alias("xml_sha256"), F.array_join("violations", ",").alias("violations"))


@query(r"""WITH a AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark), b AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM conversations),
p AS (SELECT a.w AS field, b.w AS found, levenshtein(a.w, b.w) AS d FROM a JOIN b ON abs(length(a.w) - length(b.w)) <= 1 WHERE a.w <> '' AND b.w <> '' AND levenshtein(a.w, b.w) <= 1)
SELECT field, count(*) AS matches, min(d) AS distance, arg_min(found, (d, found)) AS best FROM p GROUP BY 1""")
def fuzzy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark among the words of the conversations, one edit apart at most."""
    t = Tables(spark, sf_dir)
    words = lambda df, name: df.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias(name)).where(f"{name} <> ''")
    pairs = fuzzy.within_distance(words(t.benchmark, "field"), words(t.conversations, "found"), "field", "found", 1)
    best = F.min(F.struct("distance", "found"))
    return pairs.groupBy("field").agg(F.count("*").alias("matches"), best.alias("b")).select("field", "matches", F.col("b.distance").cast("long").alias("distance"), F.col("b.found").alias("best"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 3 AND coalesce(text, '') <> '' THEN 'damaged' WHEN coalesce(text, '') = '' THEN 'no_rows' ELSE 'read' END AS status, CASE WHEN (doc_id % 10 = 3 AND coalesce(text, '') <> '') OR coalesce(text, '') = '' THEN NULL ELSE len(string_split(text, chr(10))) END AS lines,
CASE WHEN (doc_id % 10 = 3 AND coalesce(text, '') <> '') OR coalesce(text, '') = '' THEN NULL ELSE sha256(text) END AS text_sha256 FROM documents""")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as PDF pages of forty lines and read back by their text operators; every tenth one is cut off inside a stream."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    files = pdf.written(docs, "doc_id", "text")
    cut = F.when((F.col("doc_id") % 10 == 3) & (F.coalesce("text", F.lit("")) != ""), F.expr("substring(content, 1, instr(decode(content, 'ISO-8859-1'), 'stream') + 10)")).otherwise(F.col("content"))
    found = parsers.read_as(files.withColumn("content", cut), "pdf", "doc_id")
    lines = found.groupBy("doc_id").agg(F.max("error").alias("error"), F.count("text").alias("n"), F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    read = F.col("error").isNull()
    return lines.select("doc_id", F.coalesce("error", F.lit("read")).alias("status"), F.when(read, F.col("n")).alias("lines"), F.when(read, F.sha2(text.cast("binary"), 256)).alias("text_sha256"))


#: A job is a user and a week; the manifest names the events that the job should have. Some events were lost, some came twice, some are not named.
_DAY = 86_400_000


@query("""WITH e AS (SELECT user_id * 1000 + CAST(floor(epoch_ms(ts) / 604800000) AS BIGINT) % 1000 AS job, event_id, epoch_ms(ts) AS t FROM events),
m AS (SELECT job, event_id, t FROM e WHERE event_id % 19 <> 0), j AS (SELECT job, event_id, t + CASE WHEN event_id % 23 = 0 THEN 259200000 ELSE 0 END AS t FROM e, LATERAL (SELECT unnest(range(CASE WHEN event_id % 29 = 0 THEN 2 ELSE 1 END))) WHERE event_id % 13 <> 0),
d AS (SELECT job, max(t) AS deadline FROM m GROUP BY 1), n AS (SELECT job, event_id, count(*) AS times, min(t) AS first FROM j GROUP BY 1, 2),
x AS (SELECT job, count(m.event_id) AS expected, count(*) FILTER (m.event_id IS NOT NULL AND times > 0) AS seen, coalesce(sum(greatest(times - 1, 0)), 0) AS repeated, count(*) FILTER (m.event_id IS NULL) AS foreign_,
  count(*) FILTER (m.event_id IS NOT NULL AND first > deadline + 86400000) AS late, any_value(deadline) AS deadline FROM m FULL JOIN n USING (job, event_id) JOIN d USING (job) GROUP BY job)
SELECT job, expected, seen, expected - seen AS missing, CAST(repeated AS BIGINT) AS repeated, foreign_ AS "foreign", late,
CASE WHEN expected > seen THEN 'incomplete' WHEN repeated + foreign_ + late > 0 THEN 'complete_with_findings' ELSE 'complete' END AS status
FROM x WHERE deadline + 172800000 < (SELECT max(t) FROM (SELECT t FROM m UNION ALL SELECT t FROM j)) - 3600000""")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over manifest and journal entries; a job is reported two days after its last entry was due."""
    events = Tables(spark, sf_dir).events
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    entry = F.col("event_id")
    own = events.select((F.col("user_id") * 1000 + F.floor(at / 604_800_000) % 1000).alias("job"), entry.alias("entry"), at.alias("at"))
    expected = own.where("entry % 19 <> 0").withColumn("kind", F.lit("expected"))
    times = F.when(F.col("entry") % 29 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    seen = own.where("entry % 13 <> 0").withColumn("at", F.col("at") + F.when(F.col("entry") % 23 == 0, 3 * _DAY).otherwise(0)).withColumn("kind", F.lit("seen")).select("*", F.explode(times).alias("n")).drop("n")
    both = expected.unionByName(seen).select("job", "kind", "entry", "at", F.timestamp_millis("at").alias("ts"))
    path = store.shared_folder(spark)
    both.write.parquet(path)
    return replay.replayed_once(spark, path, both.schema, 2 * _DAY, "1 hour")


@query("""WITH c AS (SELECT c_custkey // 200 AS file, row_number() OVER (PARTITION BY c_custkey // 200 ORDER BY c_custkey) AS r, c_custkey, c_name, c_mktsegment FROM customer)
SELECT file, u.col || r AS cell, CASE u.col WHEN 'A' THEN CAST(c_custkey AS VARCHAR) WHEN 'B' THEN c_name WHEN 'C' THEN '<' || c_mktsegment || ' & co>' END AS text, u.col = 'D' AS is_formula FROM c, (VALUES ('A'), ('B'), ('C'), ('D')) u(col)""")
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of 200 customers each, written and read back: shared strings, and formulas without values."""
    row = F.array(F.col("c_custkey").cast("string"), "c_name", F.concat(F.lit("<"), "c_mktsegment", F.lit(" & co>")), F.lit("=A1&B1"))
    books = Tables(spark, sf_dir).customer.groupBy(F.expr("c_custkey div 200").alias("file")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))).alias("rows"))
    files = office.written(books.select("file", F.transform("rows", lambda x: x["row"]).alias("rows")), "file", "rows", office.workbook)
    return parsers.read_as(files, "xlsx", "file").select("file", "cell", "text", "is_formula")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, CASE WHEN role = 'user' THEN 'Heading1' END AS style, sha256(replace(text, chr(10), ' ')) AS text_sha256 FROM conversations WHERE trim(replace(text, chr(10), ' ')) <> ''""")
def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text document for each conversation, a paragraph a turn and headings for the user's, written and read back."""
    text = F.concat(F.when(F.col("role") == "user", "# ").otherwise(""), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    turns = Tables(spark, sf_dir).conversations.where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("text")))).alias("turns"))
    files = office.written(turns.select("conv_id", F.transform("turns", lambda x: x["text"]).alias("lines")), "conv_id", "lines", office.document)
    found = parsers.read_as(files, "docx", "conv_id").where("error IS NULL")
    return found.select("conv_id", "ordinal", "style", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("""WITH k AS (SELECT r_regionkey, 'nation' || n_nationkey || '.csv' AS name, 'promoted' AS disposition, sha256(n_name) AS body FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT r_regionkey, u.name, u.disposition, NULL FROM region, (VALUES ('../up.csv', 'blocked:path'), ('/root.csv', 'blocked:path'), ('inner.zip', 'blocked:nested'), ('__MACOSX/x', 'sidecar'), ('folder/', 'directory')) u(name, disposition)
UNION ALL SELECT r_regionkey, 'NATION' || min(n_nationkey) || '.CSV', 'blocked:collision', NULL FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
SELECT r_regionkey, name, disposition, body AS body_sha256 FROM k""")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each region with a member a nation, and members that must not be unpacked."""
    nations = Tables(spark, sf_dir).nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    own = F.transform("n", lambda x: F.array(F.concat(F.lit("nation"), x["n_nationkey"].cast("string"), F.lit(".csv")), x["n_name"]))
    again = F.array(F.array(F.concat(F.lit("NATION"), F.element_at("n", 1)["n_nationkey"].cast("string"), F.lit(".CSV")), F.lit("again")))
    others = F.array(*(F.array(F.lit(n), F.lit("x" if not n.endswith("/") else "")) for n in ("../up.csv", "/root.csv", "inner.zip", "__MACOSX/x", "folder/")))
    files = office.written(nations.select(F.col("n_regionkey").alias("r_regionkey"), F.concat(own, again, others).alias("members")), "r_regionkey", "members", office.archive)
    found = parsers.read_as(files, "zip", "r_regionkey")
    return found.select("r_regionkey", "name", "disposition", F.sha2("content", 256).alias("body_sha256"))


#: Leading bytes in hexadecimal, the suffix that the file has, and what it is.
_SIGNATURES = [
    ("255044462D312E34", "pdf", "pdf"), ("504B030414", "xlsx", "xlsx"), ("504B030414", "docx", "docx"), ("504B0506", "bin", "zip"), ("49492A0008", "tif", "tiff"), ("4D4D002A", "dat", "tiff"), ("524946460000", "x", "riff"),
    ("89504E470D0A1A0A00", "jpg", "png"), ("FFD8FFE0", "png", "jpg"), ("3C3F786D6C20", "txt", "xml"), ("EFBBBF3C3F786D6C", "xml", "xml"), ("3C68746D6C3E", "csv", "html"), ("612C620A", "csv", "csv"), ("00010203", "exe", "unknown"),
]


@query(f"""WITH s(i, head, suffix, kind) AS (VALUES {', '.join(f"({i}, '{h}', '{x}', '{k}')" for i, (h, x, k) in enumerate(_SIGNATURES))})
SELECT kind AS format, CASE WHEN kind = 'unknown' THEN 'none' WHEN suffix = 'csv' AND kind = 'csv' THEN 'metadata' ELSE 'content' END AS basis, count(*) AS n FROM documents JOIN s ON i = doc_id % {len(_SIGNATURES)} GROUP BY 1, 2""")
def signature_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind the leading bytes of all formats, under suffixes right and wrong: bytes decide before names."""
    shapes = F.array(*(F.struct(F.lit(h).alias("head"), F.lit(x).alias("suffix")) for h, x, _ in _SIGNATURES))
    own = Tables(spark, sf_dir).documents.select(F.get(shapes, (F.col("doc_id") % len(_SIGNATURES)).cast("int")).alias("s"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    found = containers.container(F.concat(F.unhex("s.head"), "body"), F.col("s.suffix"))
    return own.select(found.alias("c")).groupBy(F.col("c.format").alias("format"), F.col("c.basis").alias("basis")).agg(F.count("*").alias("n"))
