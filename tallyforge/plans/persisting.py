"""Queries of kept records: packages, flattened facts, batch status, artifact chains, activation, arbitration, provenance, accounting, demands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import persistence as K
from ..sources import store
from .base import Tables, query


@query("""SELECT conv_id, count(*) AS records, min(turn) AS first, max(turn) AS last, CASE WHEN conv_id % 3 = 0 THEN count(*) ELSE 0 END AS read_back FROM conversations GROUP BY 1""")
def package_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns appended to a package in two parts and sealed: its index, beside what reading a third of the documents gives."""
    turns = Tables(spark, sf_dir).conversations
    package = K.Package(spark, store.shared_folder(spark), "conv_id", "turn")
    package.append(turns.where("role = 'user'"))
    package.append(turns.where("role <> 'user' OR role IS NULL"))
    index = package.seal()
    read = package.read(index.where("conv_id % 3 = 0")).groupBy("conv_id").agg(F.count("*").alias("read_back"))
    return index.join(read, "conv_id", "left").select("conv_id", "records", "first", "last", F.coalesce("read_back", F.lit(0)).alias("read_back"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 <> 0 THEN 'part ' || l_partkey END AS asset, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_shipdate AS DATE) END AS day,
'[' || CASE WHEN l_linenumber % 4 <> 0 THEN '{"role":"asset","value":"part ' || l_partkey || '"},' ELSE '' END || '{"role":"date","value":"' || CASE WHEN l_linenumber % 3 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%d.%m.%Y') END || '"},{"role":"asset","value":"supplier ' || l_suppkey || '"}]' AS payload
FROM lineitem WHERE l_linenumber % 4 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'supplier ' || l_suppkey, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_shipdate AS DATE) END,
'[{"role":"date","value":"' || CASE WHEN l_linenumber % 3 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%d.%m.%Y') END || '"},{"role":"asset","value":"supplier ' || l_suppkey || '"}]' FROM lineitem WHERE l_linenumber % 4 = 0""")
def flattened_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with an asset and a date among their roles; the day is a column only where it is an ISO date."""
    n = F.col("l_linenumber")
    role = lambda name, value: F.struct(F.lit(name).alias("role"), value.alias("value"))
    day = F.when(n % 3 != 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "dd.MM.yyyy"))
    part = F.when(n % 4 != 0, role("asset", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))))
    roles = F.array_compact(F.array(part, role("date", day), role("asset", F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")))))
    facts = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", roles.alias("roles"))
    return K.flattened(facts)


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'done' END AS status FROM events),
c AS (SELECT user_id, status, count(*) AS n FROM e GROUP BY 1, 2), x AS (SELECT status, count(*) AS n FROM e GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS records, CAST(0 AS BIGINT) AS repeated, (SELECT string_agg(status || ':' || n, ',' ORDER BY status) FROM x) AS counts,
CASE WHEN (SELECT count(*) FROM e WHERE status = 'pending') > 0 THEN 'pending' WHEN (SELECT count(*) FROM e WHERE status = 'failed') > 0 THEN 'partial' ELSE 'complete' END AS overall""")
def batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a batch whose files are the events."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("done")
    return K.batch_status(Tables(spark, sf_dir).events.select("event_id", kind.alias("status")), "event_id", "status").drop("checksum")


@query("""SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, n, CASE WHEN n IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unobserved' ELSE 'found' END AS status
FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 20 GROUP BY 1) ON o_orderkey = l_orderkey""")
def observation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed orders and the records of their larger lines: what is found, missing, or was never observed."""
    t = Tables(spark, sf_dir)
    seen = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("orderkey"))
    return K.looked_up(seen, t.lineitem.where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.count("*").alias("n")), "orderkey")


@query("""WITH RECURSIVE line AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
there AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 17 <> 0), e AS (SELECT a.o_orderkey AS parent, b.o_orderkey AS child FROM line a JOIN line b ON a.o_custkey = b.o_custkey AND b.i = a.i + 1 WHERE a.o_orderkey IN (FROM there) AND b.o_orderkey IN (FROM there)),
up AS (SELECT child AS artifact, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT up.artifact, e.parent, depth + 1 FROM up JOIN e ON e.child = up.ancestor)
SELECT artifact, ancestor, depth FROM up""")
def artifact_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts, each made from the customer's one before; every seventeenth was put again as deleted."""
    orders = Tables(spark, sf_dir).orders
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = orders.select(F.lag("o_orderkey").over(w).alias("parent"), F.col("o_orderkey").alias("child")).where("parent IS NOT NULL")
    first = orders.select(F.col("o_orderkey").alias("artifact"), F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    again = orders.where("o_orderkey % 17 = 0").select(F.col("o_orderkey").alias("artifact"), F.lit(2).alias("version"), F.lit(True).alias("deleted"))
    return K.chains(K.latest(first.unionByName(again), "artifact", ["version"]), edges, "artifact")


@query("""WITH v AS (SELECT l_orderkey AS k, l_linenumber AS version, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT k, min(version) AS low, max(version) AS high FROM v GROUP BY 1),
s AS (SELECT k, version, CASE WHEN version = low AND k % 3 <> 0 THEN 'active' WHEN q % 3 = 0 THEN 'candidate' WHEN q % 3 = 1 THEN 'validated' ELSE 'superseded' END AS state FROM v JOIN b USING (k)),
a AS (SELECT k, high AS t, CASE WHEN k % 5 = 0 THEN 99 WHEN k % 3 <> 0 THEN low END AS expected, CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END AS n, low FROM b WHERE k % 2 = 0),
p AS (SELECT a.*, (SELECT max(version) FROM s WHERE s.k = a.k AND state = 'active') AS act, EXISTS (SELECT 1 FROM s WHERE s.k = a.k AND version = t AND state IN ('validated', 'superseded')) AS ready FROM a),
o AS (SELECT *, CASE WHEN n > 1 THEN 'contested' WHEN act IS DISTINCT FROM expected THEN 'stale' WHEN NOT ready THEN 'not_ready' ELSE 'applied' END AS outcome FROM p)
SELECT s.k AS l_orderkey, version, CASE WHEN outcome = 'applied' AND version = t THEN 'active' WHEN outcome = 'applied' AND state = 'active' THEN 'superseded' ELSE state END AS state, outcome FROM s LEFT JOIN o ON o.k = s.k""")
def compare_and_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as versions of an order; every second order is to activate its last one, some with a stale or a contested request."""
    v = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("version")).agg(F.max("l_quantity").cast("long").alias("q"))
    bounds = v.groupBy("l_orderkey").agg(F.min("version").alias("low"), F.max("version").alias("high"))
    k, q = F.col("l_orderkey"), F.col("q")
    state = F.when((F.col("version") == F.col("low")) & (k % 3 != 0), "active").when(q % 3 == 0, "candidate").when(q % 3 == 1, "validated").otherwise("superseded")
    versions = v.join(bounds, "l_orderkey").select("l_orderkey", "version", state.alias("state"))
    expected = F.when(k % 5 == 0, 99).when(k % 3 != 0, F.col("low"))
    asked = bounds.where("l_orderkey % 2 = 0").select("l_orderkey", F.col("high").alias("version"), expected.alias("expected"))
    return K.activated(versions, asked.unionByName(asked.where("l_orderkey % 11 = 0")), "l_orderkey")


#: (rule, status, signal of the lines' flags, of their states, of the order): the least rule that fits decides.
ARBITRATION = [
    (1, "review", "conflict", None, "P"), (2, "accepted", "N", "O", None), (3, "accepted", "R", "F", "F"), (4, "rejected", "A", "F", None), (5, "partial", "conflict", "F", None), (6, "partial", "conflict", "conflict", None),
    (7, "unsupported", "absent", None, None), (8, "orphan", None, None, "absent"),
]


def _arbitration_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    rules = ", ".join(f"({n}, '{status}', {text(a)}, {text(b)}, {text(c)})" for n, status, a, b, c in ARBITRATION)
    return f"""WITH r(rule, status, a, b, c) AS (VALUES {rules}), one AS (SELECT l_orderkey AS k, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'conflict' ELSE min(l_returnflag) END AS a, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'conflict' ELSE min(l_linestatus) END AS b FROM lineitem WHERE l_quantity > 10 GROUP BY 1),
x AS (SELECT coalesce(k, o_orderkey) AS k, coalesce(a, 'absent') AS a, coalesce(b, 'absent') AS b, coalesce(o_orderstatus, 'absent') AS c FROM one FULL JOIN (FROM orders WHERE o_orderkey % 10 <> 0) ON k = o_orderkey)
SELECT k AS orderkey, coalesce(arg_min(status, rule), 'undecided') AS status, min(rule) AS rule FROM x LEFT JOIN r ON (r.a IS NULL OR r.a = x.a) AND (r.b IS NULL OR r.b = x.b) AND (r.c IS NULL OR r.c = x.c) GROUP BY 1"""


@query(_arbitration_sql())
def signal_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables of signals on orders, joined and decided by a table of rules."""
    t = Tables(spark, sf_dir)
    lines = t.lineitem.where("l_quantity > 10")
    signals = {
        "flags": lines.select(F.col("l_orderkey").alias("orderkey"), F.col("l_returnflag").alias("signal")), "states": lines.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linestatus").alias("signal")),
        "order": t.orders.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("signal")),
    }
    return K.arbitrated(signals, "orderkey", spark.createDataFrame(ARBITRATION, "rule int, status string, flags string, states string, order string"))


@query("""SELECT doc_id, 'n_chars' AS field, CAST(n_chars + 1 AS VARCHAR) AS stated, CAST(length(text) AS VARCHAR) AS derived FROM documents WHERE doc_id % 7 = 0 AND n_chars + 1 IS DISTINCT FROM length(text)
UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR), CAST(length(text) AS VARCHAR) FROM documents WHERE doc_id % 7 <> 0 AND n_chars IS DISTINCT FROM length(text)
UNION ALL SELECT doc_id, 'sha256', NULL, sha256(text) FROM documents WHERE doc_id % 9 = 0 AND text IS NOT NULL UNION ALL SELECT doc_id, 'n_lines', CAST(len(string_split(text, chr(10))) + 2 AS VARCHAR), CAST(len(string_split(text, chr(10))) AS VARCHAR) FROM documents WHERE doc_id % 21 = 5 AND text IS NOT NULL""")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stated about the documents against what their texts give; some statements were altered."""
    i = F.col("doc_id")
    lines = F.size(F.split("text", "\n"))
    stated = Tables(spark, sf_dir).documents.select("doc_id", "text", (F.col("n_chars") + F.when(i % 7 == 0, 1).otherwise(0)).alias("n_chars"), F.when(i % 9 != 0, F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"), (lines + F.when(i % 21 == 5, 2).otherwise(0)).alias("n_lines"))
    return K.provenance_differences(stated, {"n_chars": F.char_length("text"), "sha256": F.sha2(F.col("text").cast("binary"), 256), "n_lines": lines}, "doc_id")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_orderkey, l_linenumber, part + CASE WHEN q > 48 THEN 1 ELSE 0 END AS part FROM c WHERE q > 2 UNION ALL SELECT l_orderkey, l_linenumber, part FROM c WHERE q = 40 UNION ALL SELECT l_orderkey, l_linenumber + 10, part FROM c WHERE q = 25),
g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(part) AS part FROM s GROUP BY 1, 2)
SELECT coalesce(c.l_orderkey, g.l_orderkey) AS l_orderkey, coalesce(c.l_linenumber, g.l_linenumber) AS l_linenumber, CASE WHEN c.l_orderkey IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN c.part = g.part THEN 'same' ELSE 'changed' END AS status
FROM c FULL JOIN g ON c.l_orderkey = g.l_orderkey AND c.l_linenumber = g.l_linenumber""")
def submission_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of orders against a submission that left out, changed, repeated and made up some."""
    at = ["l_orderkey", "l_linenumber"]
    cells = Tables(spark, sf_dir).lineitem.groupBy(*at).agg(F.min("l_partkey").alias("part"), F.max(F.col("l_quantity").cast("long")).alias("q"))
    sent = cells.where("q > 2").withColumn("part", F.col("part") + F.when(F.col("q") > 48, 1).otherwise(0))
    made_up = cells.where("q = 25").withColumn("l_linenumber", F.col("l_linenumber") + 10)
    return K.accounted(cells, sent.unionByName(cells.where("q = 40")).unionByName(made_up), at, "part")


@query("""WITH d AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS kind FROM orders), f AS (SELECT l_orderkey AS k, l_returnflag AS kind, bool_or(l_quantity >= 25) AS usable FROM lineitem GROUP BY 1, 2), h AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
x AS (SELECT d.kind, CASE WHEN usable THEN 'satisfied' WHEN f.k IS NOT NULL THEN 'unusable' WHEN h.k IS NOT NULL THEN 'wrong_kind' ELSE 'no_fact' END AS cause FROM d LEFT JOIN f ON f.k = d.k AND f.kind = d.kind LEFT JOIN h ON h.k = d.k)
SELECT kind, count(*) AS demands, count(*) FILTER (cause = 'satisfied') AS satisfied, count(*) FILTER (cause = 'unusable') AS unusable, count(*) FILTER (cause = 'wrong_kind') AS wrong_kind, count(*) FILTER (cause = 'no_fact') AS no_fact FROM x GROUP BY 1""")
def demand_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order demands a line of one flag: how many have one that is large enough, and why the others don't."""
    t = Tables(spark, sf_dir)
    k = F.col("o_orderkey")
    demands = t.orders.select(k.alias("k"), F.when(k % 3 == 0, "R").when(k % 3 == 1, "A").otherwise("N").alias("kind"))
    facts = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("kind"), "l_quantity")
    return K.demand_metrics(demands, facts, "k", "kind", lambda: F.col("l_quantity") >= 25)


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'no_such_day' WHEN 2 THEN 'not_a_date' WHEN 3 THEN NULL WHEN 4 THEN 'grouping' WHEN 5 THEN 'not_a_number' WHEN 6 THEN 'blank' ELSE 'not_a_code' END AS reason FROM orders""")
def role_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why literals of orders aren't values of their roles."""
    n = F.col("o_orderkey") % 8
    role = F.when(n <= 2, "date").when(n <= 5, "amount").when(n == 6, "note").otherwise("currency")
    year = F.date_format("o_orderdate", "yyyy")
    literal = (
        F.when(n == 0, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm")).when(n == 1, F.concat(F.lit("30.02."), year)).when(n == 2, F.concat(F.lit("Q1 "), year)).when(n == 3, F.format_number("o_totalprice", 2))
        .when(n == 4, F.concat(F.lit("1,2,"), F.floor("o_totalprice").cast("string"))).when(n == 5, F.col("o_orderpriority")).when(n == 6, F.lit("  ")).otherwise(F.concat(F.col("o_orderstatus"), F.lit("1")))
    )
    return Tables(spark, sf_dir).orders.select("o_orderkey", V.role_rejection(role, literal, "comma_dot").alias("reason"))
