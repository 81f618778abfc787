"""Queries of the read surface, of role values, of text and CSV sources, and of facts in neighbouring cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import pages as P
from ..operators import sequences as S
from ..sources import parsers, store
from .base import Tables, query


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 500 ORDER BY o_orderkey LIMIT 25 OFFSET 25) SELECT *, (SELECT max(o_orderkey) FROM p) AS next_after, sha256('orders|F|' || (SELECT max(o_orderkey) FROM p)) AS continuation FROM p""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that the token of the one before it continues."""
    rows = Tables(spark, sf_dir).orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    first = P.keyset_page(rows, "o_orderkey", 500, 25, "orders|F").first()
    return P.resumed_page(rows, "o_orderkey", first["next_after"], first["continuation"], 25, "orders|F")


@query("""SELECT o_orderkey, CASE WHEN coalesce(old, 0) = 0 THEN 'missing' WHEN n = old THEN 'fresh' ELSE 'stale' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_shipdate < TIMESTAMP '1997-01-01') AS old FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def fresh_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders bound to the line counts of a published snapshot (the lines shipped before 1997), against the lines that are there now."""
    t = Tables(spark, sf_dir)
    counts = lambda lines: lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("version"))
    old = counts(t.lineitem.where(F.col("l_shipdate").cast("timestamp_ntz") < F.lit("1997-01-01").cast("timestamp_ntz")))
    path = store.publish_snapshot(old, store.shared_folder(spark), "1996")
    return P.fresh_only(t.orders.select("o_orderkey"), spark.read.schema(old.schema).parquet(path), counts(t.lineitem), "o_orderkey", "version")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('purchase', 'signup', 'view')")
def unclassified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose type no domain claims."""
    claimed = spark.createDataFrame([("purchase",), ("signup",), ("view",)], "event_type string")
    return Tables(spark, sf_dir).events.select("event_id", "event_type").join(claimed, "event_type", "left_anti").select("event_id", "event_type")


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, event_id AS ref FROM events")
def provenance_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of a record with their places."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return Tables(spark, sf_dir).events.select("user_id", place.alias("pos"), F.col("event_id").alias("ref"))


@query("SELECT DISTINCT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45))")
def owner_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units to packages to facts: only what an owned unit reaches."""
    t = Tables(spark, sf_dir)
    packages = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(t.lineitem.where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return t.customer.select("c_custkey", "c_mktsegment").join(packages, "c_custkey", "left_semi").dropDuplicates()


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_partkey), list(l_suppkey)))), ',') AS refs FROM lineitem GROUP BY l_orderkey")
def evidence_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct references of a unit's candidates, of all kinds."""
    refs = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("l_partkey", "l_suppkey")))))
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.array_join(refs.cast("array<string>"), ",").alias("refs"))


_ROLES = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'amount' WHEN 2 THEN 'currency' ELSE 'note' END AS role, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority FROM orders"


@query(f"""SELECT o_orderkey, CASE role WHEN 'date' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'amount' THEN (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') WHEN 'currency' THEN CASE WHEN o_orderkey % 8 = 2 THEN 'RUB' END ELSE o_orderpriority END AS value,
CASE role WHEN 'date' THEN 'date_prefix' WHEN 'amount' THEN 'decimal_comma_dot' WHEN 'currency' THEN CASE WHEN o_orderkey % 8 = 2 THEN 'currency_upper' END ELSE 'text_trim' END AS transform FROM ({_ROLES})""")
def role_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of four roles, written as sources write them, with the transform that normalized each."""
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    role = F.when(key % 4 == 0, "date").when(key % 4 == 1, "amount").when(key % 4 == 2, "currency").otherwise("note")
    day = F.when(key % 8 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd' 10:00'"))
    amount = F.concat(F.format_number((cents / 100).cast("decimal(20,2)"), 2))
    literal = F.when(role == "date", day).when(role == "amount", amount).when(role == "currency", F.when(key % 8 == 2, " rub ").otherwise("roubles")).otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))
    found = Tables(spark, sf_dir).orders.select(key, V.role_value(role, literal, "comma_dot").alias("v"))
    return found.select("o_orderkey", "v.value", "v.transform")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_custkey AS VARCHAR) || '.5' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN 'USD' END AS value FROM orders""")
def mechanical_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized values reproduced from their literals by a named rule; what no rule covers has none."""
    key = F.col("o_orderkey")
    kind = F.when(key % 5 == 0, "trimmed_text").when(key % 5 == 1, "decimal_dot").when(key % 5 == 2, "iso_date_exact").when(key % 5 == 3, "currency_visible").otherwise("decimal_dot")
    literal = F.when(key % 5 == 0, F.concat("o_orderpriority", F.lit("\t "))).when(key % 5 == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(",5"))).when(key % 5 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key % 5 == 3, "usd").otherwise("n/a")
    return Tables(spark, sf_dir).orders.select(key, V.reproduced(kind, F.trim(F.replace(literal, F.lit("\t"), F.lit(" ")))).alias("value"))


@query("""SELECT doc_id, substring(coalesce(text, ''), 11, 40) AS value, sha256(substring(coalesce(text, ''), 11, 40)) AS checksum, length(coalesce(text, '')) >= 50 AS complete FROM documents""")
def source_value_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text span resolved by offsets, with its checksum and whether the source reaches that far."""
    text = F.coalesce("text", F.lit(""))
    span = F.substring(text, 11, 40)
    return Tables(spark, sf_dir).documents.select("doc_id", span.alias("value"), F.sha2(span.cast("binary"), 256).alias("checksum"), (F.char_length(text) >= 50).alias("complete"))


@query("""SELECT p_partkey, p_partkey % 3 <> 0 AS header FROM part""")
def header_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows with names only, and ones with a number among them."""
    cells = F.when(F.col("p_partkey") % 3 == 0, F.array("p_name", F.col("p_size").cast("string"))).otherwise(F.array("p_brand", "p_type"))
    return Tables(spark, sf_dir).part.select("p_partkey", V.looks_like_header(cells).alias("header"))


@query("""WITH c AS (SELECT c_custkey // 400 AS file, c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey // 400 ORDER BY c_custkey) AS k FROM customer)
SELECT file, count(*) AS n_rows, string_agg(c_custkey || '/' || c_name, ';' ORDER BY k) FILTER (k <= 5) AS preview FROM c GROUP BY file""")
def csv_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of CSV files of 400 customers each, beside the number of all rows."""
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(';"'), "c_name", F.lit('"'))
    bodies = Tables(spark, sf_dir).customer.groupBy(F.expr("c_custkey div 400").alias("file")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines"))
    files = bodies.select("file", F.concat(F.lit("key;name\n"), F.concat_ws("\n", F.transform("lines", lambda x: x["line"]))).alias("content"))
    rows = parsers.read_as(files, "csv", "file").where("row > 0")
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("row") <= 5, F.struct("row", F.array_join("cells", "/").alias("cells"))))), lambda x: x["cells"])
    return rows.groupBy("file").agg(F.count("*").alias("n_rows"), F.array_join(shown, ";").alias("preview"))


@query(r"""SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(l, lambda x: trim(x, ' ' || chr(9)) <> '')) AS BIGINT) AS n_filled, CAST(list_max(list_transform(l, lambda x: length(x))) AS BIGINT) AS longest FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n') AS l FROM documents)""")
def txt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole texts: all, those with content, and the longest one."""
    lines = F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")
    rows = Tables(spark, sf_dir).documents.select("doc_id", lines.alias("lines"))
    filled = F.size(F.filter("lines", lambda x: F.regexp_replace(x, "[ \t]+", "") != ""))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), filled.cast("long").alias("n_filled"), F.array_max(F.transform("lines", F.char_length)).cast("long").alias("longest"))


@query("""SELECT l_orderkey, min_by(l_returnflag, l_linenumber) AS label, max_by(l_partkey, l_linenumber) AS value FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2 AND min(l_linenumber) < max(l_linenumber)""")
def adjacent_cell_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two lines as rows of two cells: the first is the label of the second."""
    cells = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.struct("l_returnflag", "l_partkey").alias("cell"))
    return P.adjacent_facts(cells, ["l_orderkey"], "l_linenumber", "cell").select("l_orderkey", "label.l_returnflag", "value.l_partkey").toDF("l_orderkey", "label", "value")


@query("""WITH f AS (SELECT l_suppkey, min(l_orderkey) AS first FROM lineitem GROUP BY 1), t AS (SELECT DISTINCT l_suppkey, l_linenumber FROM (SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)),
h AS (SELECT l.l_suppkey, l.l_linenumber, first FROM lineitem l JOIN f ON f.l_suppkey = l.l_suppkey AND l.l_orderkey = first ANTI JOIN t ON t.l_suppkey = l.l_suppkey AND t.l_linenumber = l.l_linenumber),
a AS (SELECT l_suppkey, any_value(l_linenumber) AS l_linenumber, any_value(first) AS first FROM h GROUP BY 1 HAVING count(*) = 1)
SELECT l.l_suppkey, l.l_orderkey, l.l_linenumber, l.l_returnflag FROM lineitem l JOIN a ON a.l_suppkey = l.l_suppkey AND a.l_linenumber = l.l_linenumber WHERE l.l_orderkey > first""")
def column_header_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tables: the cells below the header of the first order's only line."""
    return P.column_facts(Tables(spark, sf_dir).lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag"), "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", F.lit(True))


_SEQUENCES = "SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS s FROM lineitem GROUP BY 1"


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring orders with the flags of their lines."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    own = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l_returnflag"]).alias("left"))
    return own.join(own.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("left").alias("right")), "l_orderkey")


@query(f"WITH s AS ({_SEQUENCES}) SELECT a.l_orderkey, CAST(levenshtein(a.s, b.s) AS INTEGER) AS distance FROM s a JOIN s b ON b.l_orderkey = a.l_orderkey + 1")
def sequence_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("l_orderkey", V.sequence_distance(F.col("left"), F.col("right")).alias("distance"))


@query(f"""WITH RECURSIVE s AS ({_SEQUENCES}), p AS (SELECT a.l_orderkey, a.s AS x, b.s AS y FROM s a JOIN s b ON b.l_orderkey = a.l_orderkey + 1), r AS (SELECT l_orderkey, x, y, 0 AS i, list_transform(generate_series(0, length(y)), lambda j: 0) AS row FROM p
UNION ALL SELECT l_orderkey, x, y, i + 1, list_reduce(list_transform(generate_series(1, length(y)), lambda j: [CAST(j AS BIGINT)]), lambda acc, j: list_append(acc, CASE WHEN y[j[1]] = x[i + 1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[-1]) END), [CAST(0 AS BIGINT)]) FROM r WHERE i < length(x))
SELECT l_orderkey, CAST(row[-1] AS INTEGER) AS common FROM r WHERE i = length(x)""")
def common_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("l_orderkey", V.common_length(F.col("left"), F.col("right")).alias("common"))


@query("""WITH a AS (SELECT user_id % 50 AS k, count(*) AS n FROM events GROUP BY 1), b AS (SELECT o_custkey % 60 AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS id, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS extra FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def bijective_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two multisets of ids, and what each lacks of the other."""
    t = Tables(spark, sf_dir)
    return P.multiset_coverage(t.events.select((F.col("user_id") % 50).alias("id")), t.orders.select((F.col("o_custkey") % 60).alias("id")), "id")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS types FROM f GROUP BY user_id""")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in order of their first place."""
    first = Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def candidate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last candidate of each id."""
    rows = Tables(spark, sf_dir).events.select("user_id", "event_type", "event_id", "value")
    return S.latest(rows, ["user_id", "event_type"], [F.desc("event_id")])


@query("""SELECT sha256(event_type || '|' || (user_id % 3)) AS request, count(DISTINCT user_id) AS demands, min(user_id) AS first FROM events GROUP BY 1""")
def request_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demands of one type and scope are one request."""
    request = F.sha2(F.concat_ws("|", "event_type", (F.col("user_id") % 3).cast("string")), 256)
    return Tables(spark, sf_dir).events.groupBy(request.alias("request")).agg(F.count_distinct("user_id").alias("demands"), F.min("user_id").alias("first"))


@query("""SELECT source, count(*) AS documents, count(*) FILTER (coalesce(text, '') <> '') AS with_text, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, CAST(sum(len(regexp_split_to_array(coalesce(text, ''), chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY source""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of documents, texts, characters and lines by source."""
    text = F.coalesce("text", F.lit(""))
    return Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(text != "").alias("with_text"), F.sum(F.char_length(text).cast("long")).alias("chars"), F.sum(F.size(F.split(text, "\n")).cast("long")).alias("lines"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n = 1 THEN 'materialized' ELSE 'presence' END AS kept FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)""")
def annotation_atomicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of one target are materialized; of several, only their presence is kept."""
    target = ["l_orderkey", "l_linenumber"]
    rows = Tables(spark, sf_dir).lineitem.select(*target, "l_partkey")
    ends = F.array_distinct(F.array(F.min("l_partkey"), F.max("l_partkey")))
    bare = F.count("*") > F.count("l_partkey")
    counted = rows.groupBy(*target).agg(F.count("*").alias("n"), ends.alias("parts"), bare.alias("bare"))
    # one or two annotations are their least and greatest; only targets of more are looked up again
    many = (F.col("n") > 2) & (F.col("bare") | (F.size("parts") > 1))
    few = F.when(F.col("bare") & (F.col("n") == 2), F.array_distinct(F.array_append("parts", F.lit(None).cast("long")))).otherwise(F.col("parts"))
    found = counted.where(~many).select(*target, F.explode(few).alias("l_partkey"), F.when(F.col("n") == 1, "materialized").otherwise("presence").alias("kept"))
    same = F.col("l.l_orderkey").eqNullSafe(F.col("r.l_orderkey")) & F.col("l.l_linenumber").eqNullSafe(F.col("r.l_linenumber"))
    rest = rows.alias("l").join(counted.where(many).select(*target).alias("r"), same, "left_semi").dropDuplicates()
    return found.unionByName(rest.withColumn("kept", F.lit("presence")))


@query("""SELECT a.l_orderkey, a.l_linenumber, CAST(round(a.l_extendedprice * 100) AS BIGINT) AS cents, CASE b.l_returnflag WHEN 'A' THEN 'EUR' WHEN 'N' THEN 'RUB' ELSE 'USD' END AS currency FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, any_value(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1) b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def bound_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An amount's currency from the column that it is bound to (the next one of its row), never from what is near."""
    rows = Tables(spark, sf_dir).lineitem
    code = F.when(F.col("l_returnflag") == "A", "EUR").when(F.col("l_returnflag") == "N", "RUB").otherwise("USD")
    columns = rows.groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber")).agg(F.count("*").alias("n"), F.any_value(code).alias("currency")).where("n = 1").drop("n")
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")).join(columns, ["l_orderkey", "l_linenumber"])
