"""Queries of lot costs, group states, representation choice and source units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lots as L
from ..operators import routing as R
from .base import Tables, query

_LOTS = "SELECT l_partkey, lot, d, q, side, cents FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS lot, min(CAST(l_shipdate AS DATE)) AS d, CAST(max(l_quantity) AS BIGINT) AS q, min(l_returnflag) AS side, CAST(round(max(l_extendedprice) * 100) AS BIGINT) AS cents FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY 1, 2)"
_MATCHES = f"""WITH r AS ({_LOTS}), c AS (SELECT *, sum(q) OVER (PARTITION BY l_partkey, side ORDER BY d, lot ROWS UNBOUNDED PRECEDING) AS hi FROM r),
m AS (SELECT b.l_partkey, b.lot AS buy_ref, s.lot AS sell_ref, b.q, b.d, CAST(least(b.hi, s.hi) - greatest(b.hi - b.q, s.hi - s.q) AS BIGINT) AS matched, CAST(least(b.hi, s.hi) - (b.hi - b.q) AS BIGINT) AS upto, b.cents FROM c b JOIN c s ON b.l_partkey = s.l_partkey AND b.side = 'N' AND s.side = 'R' AND b.hi - b.q < s.hi AND s.hi - s.q < b.hi)"""
_DOUBT = """t AS (SELECT l_partkey, buy_ref, sum(matched) AS taken FROM m GROUP BY ALL),
g AS (SELECT r.l_partkey, d, count(DISTINCT (cents // gcd(cents, q)) || '/' || (q // gcd(cents, q))) AS units, sum(q) AS bought, coalesce(sum(taken), 0) AS taken FROM r LEFT JOIN t ON r.l_partkey = t.l_partkey AND lot = buy_ref WHERE side = 'N' GROUP BY 1, 2)"""


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots by part: flag N buys, flag R sells; a line is a lot, with its price in cents."""
    lines = Tables(spark, sf_dir).lineitem.where("l_returnflag IN ('N', 'R')").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lot"), F.col("l_shipdate").cast("date").alias("d"), "l_quantity", "l_returnflag", "l_extendedprice")
    return lines.groupBy("l_partkey", "lot").agg(F.min("d").alias("d"), F.max("l_quantity").cast("long").alias("q"), F.min("l_returnflag").alias("side"), F.round(F.max("l_extendedprice") * 100).cast("long").alias("cents"))


def _is_buy():
    return F.col("side") == "N"


@query(f"""{_MATCHES}, k AS (SELECT l_partkey, sell_ref, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(CAST(upto AS HUGEINT) * cents // q - CAST(upto - matched AS HUGEINT) * cents // q) AS BIGINT) AS cost, count(*) AS lots FROM m GROUP BY ALL)
SELECT r.l_partkey, r.lot AS sell_ref, coalesce(matched, 0) AS matched, cost, coalesce(lots, 0) AS lots, CASE WHEN matched = q THEN 'covered' WHEN matched > 0 THEN 'partial' ELSE 'uncovered' END AS status FROM r LEFT JOIN k ON r.l_partkey = k.l_partkey AND r.lot = k.sell_ref WHERE side = 'R'""")
def fifo_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sell cost: shares of the lots it takes, by quantity."""
    return L.disposal_costs(_lots(spark, sf_dir), "l_partkey", ["d"], _is_buy(), "q", "lot", "cents")


@query(f"""{_MATCHES}, {_DOUBT} SELECT l_partkey, d AS day FROM g WHERE units > 1 AND taken > 0 AND taken < bought""")
def fifo_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ambiguous_days(_lots(spark, sf_dir), "l_partkey", "d", _is_buy(), "q", "lot", "cents").withColumnRenamed("d", "day")


@query(f"""{_MATCHES}, {_DOUBT}, s AS (SELECT l_partkey, sum(CASE WHEN side = 'R' THEN q ELSE 0 END) AS sold, sum(CASE WHEN side = 'N' THEN q ELSE 0 END) AS bought FROM r GROUP BY 1), x AS (SELECT DISTINCT l_partkey FROM g WHERE units > 1 AND taken > 0 AND taken < bought)
SELECT s.l_partkey, CASE WHEN sold = 0 THEN 'inactive' WHEN sold > bought THEN 'short' WHEN x.l_partkey IS NOT NULL THEN 'ambiguous' ELSE 'ready' END AS state FROM s LEFT JOIN x ON s.l_partkey = x.l_partkey""")
def group_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.group_states(_lots(spark, sf_dir), "l_partkey", "d", _is_buy(), "q", "lot", "cents")


@query("""WITH u AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1), c AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, CAST(round(a.l_extendedprice * 100) AS BIGINT) AS gross, CAST(round(b.l_extendedprice * 100) AS BIGINT) * CAST(round(b.l_discount * 100) AS BIGINT) // 100 AS charge FROM lineitem a JOIN u USING (l_orderkey, l_linenumber) JOIN c USING (l_orderkey, l_linenumber) JOIN lineitem b USING (l_orderkey, l_linenumber) WHERE b.l_discount >= 0.05""")
def same_row_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges (discounts of 5 % and more) joined to the line they stand in, in whole cents."""
    lines, keys = Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"]
    gross = lines.select(*keys, F.round(F.col("l_extendedprice") * 100).cast("long").alias("gross"))
    return L.same_row(gross, lines.where("l_discount >= 0.05").select(*keys, F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) DIV 100").alias("charge")), keys)


_PRESENT = """SELECT o_orderkey, any_value(o_orderstatus) AS status, CAST(coalesce(sum(round(l_extendedprice * 100)), 0) AS BIGINT) AS detail, CAST(round(any_value(o_totalprice) * 100) AS BIGINT) AS aggregate, count(l_orderkey) > 0 AS has_detail, any_value(o_orderpriority) < '4' AS has_aggregate FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""


def _assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail (line) and aggregate (total) assertions of each order, in cents; totals of priorities 4 and 5 aren't asserted."""
    t = Tables(spark, sf_dir)
    details = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("detail"))
    orders = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("aggregate"), (F.col("o_orderpriority") < "4").alias("has_aggregate"))
    return orders.join(details, "o_orderkey", "left").withColumn("has_detail", F.col("detail").isNotNull())


@query(f"""SELECT o_orderkey, CASE WHEN status = 'F' AND has_detail THEN 'detail' WHEN status = 'O' AND has_aggregate THEN 'aggregate' ELSE 'failed' END AS chosen, CASE WHEN status = 'F' AND has_detail THEN detail WHEN status = 'O' AND has_aggregate THEN aggregate END AS cents FROM ({_PRESENT})""")
def detail_or_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proven complete details, else a proven matching aggregate, else none; the two are never compared."""
    rows = _assertions(spark, sf_dir)
    chosen = R.cascade((F.expr("status = 'F' AND has_detail"), "detail"), (F.expr("status = 'O' AND has_aggregate"), "aggregate"), otherwise="failed")
    return rows.withColumn("chosen", chosen).select("o_orderkey", "chosen", F.when(F.col("chosen") == "detail", F.col("detail")).when(F.col("chosen") == "aggregate", F.col("aggregate")).alias("cents"))


@query(f"""SELECT o_orderkey, CASE WHEN has_detail AND has_aggregate THEN 'hybrid' WHEN has_detail THEN 'detail' WHEN has_aggregate THEN 'aggregate' ELSE 'none' END AS mode FROM ({_PRESENT})""")
def representation_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = R.cascade((F.col("has_detail") & F.col("has_aggregate"), "hybrid"), (F.col("has_detail"), "detail"), (F.col("has_aggregate"), "aggregate"), otherwise="none")
    return _assertions(spark, sf_dir).select("o_orderkey", both.alias("mode"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'rejected' WHEN lang IS NULL THEN 'needs_review' WHEN n_chars > 20000 THEN 'eligible_in_parts' ELSE 'eligible' END AS status, CASE WHEN text IS NULL OR trim(text) = '' OR lang IS NULL THEN 'none' WHEN n_chars > 20000 THEN 'slices' ELSE 'whole' END AS handoff FROM documents""")
def source_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank, unknown, large = F.expr("text IS NULL OR trim(text) = ''"), F.col("lang").isNull(), F.col("n_chars") > 20_000
    status = R.cascade((blank, "rejected"), (unknown, "needs_review"), (large, "eligible_in_parts"), otherwise="eligible")
    handoff = R.cascade((blank | unknown, "none"), (large, "slices"), otherwise="whole")
    return Tables(spark, sf_dir).documents.select("doc_id", status.alias("status"), handoff.alias("handoff"))


@query("""SELECT source, count(*) AS files, count(*) FILTER (doc_id % 10 <> 0) AS logical, count(*) FILTER (doc_id % 10 = 0) AS containers, count(*) = count(DISTINCT doc_id) AS unique_refs FROM documents GROUP BY source""")
def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logical document for each file that is no container (ids divisible by ten stand for those)."""
    container = F.col("doc_id") % 10 == 0
    return Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("files"), F.count_if(~container).alias("logical"), F.count_if(container).alias("containers"), (F.count("*") == F.count_distinct("doc_id")).alias("unique_refs"))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'asked' WHEN 'assistant' THEN 'answered' ELSE 'context' END AS bucket, lag(turn) OVER w AS previous, lead(turn) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit in exactly one bucket, with its siblings."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    bucket = R.cascade((F.col("role") == "user", "asked"), (F.col("role") == "assistant", "answered"), otherwise="context")
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", bucket.alias("bucket"), F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("following"))


@query("""WITH v AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS active FROM events)
SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'REJECTED' WHEN event_id = active THEN 'ACTIVE' WHEN event_type = 'purchase' THEN 'SUPERSEDED' WHEN event_id > coalesce(active, -1) THEN 'CANDIDATE' ELSE 'SUPERSEDED' END AS state FROM v""")
def version_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a user: the newest activation (purchase) is active, at most one; older ones are superseded, newer others are candidates."""
    activates = F.col("event_type") == "purchase"
    rows = Tables(spark, sf_dir).events.select("user_id", "event_id", "event_type")
    newest = rows.where(activates).groupBy("user_id").agg(F.max("event_id").alias("active"))
    state = R.cascade((F.col("event_type") == "error", "REJECTED"), (F.col("event_id") == F.col("active"), "ACTIVE"), (activates, "SUPERSEDED"), (F.col("event_id") > F.coalesce("active", F.lit(-1)), "CANDIDATE"), otherwise="SUPERSEDED")
    return rows.join(newest, "user_id", "left").select("user_id", "event_id", state.alias("state"))


@query("""WITH a AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant'), f AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, CASE WHEN role = 'assistant' THEN 'accepted' ELSE 'context' END AS part FROM conversations c JOIN a ON a.conv_id = c.conv_id JOIN f ON f.conv_id = c.conv_id WHERE role = 'assistant' OR c.turn = f.turn""")
def role_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows, and the first row of each table that has any."""
    rows = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role")
    accepted = rows.where("role = 'assistant'").select("conv_id", "turn", F.lit("accepted").alias("part"))
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("first")).where("first.role <> 'assistant'").select("conv_id", "first.turn", F.lit("context").alias("part"))
    return accepted.unionByName(first.join(accepted, "conv_id", "left_semi"))


@query("""SELECT l_orderkey, bool_and(l_linestatus = 'F') AND bool_and(l_tax <= 0.08) AS allowed, count(*) FILTER (l_linestatus <> 'F' OR l_tax > 0.08) AS missing FROM lineitem GROUP BY l_orderkey""")
def expense_allowability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed only where every required flag of every line holds."""
    flag = F.expr("l_linestatus = 'F' AND l_tax <= 0.08")
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.bool_and(flag).alias("allowed"), F.count_if(~flag).alias("missing"))


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN 'not_required' WHEN open_ > 0 THEN 'evidence_missing' ELSE 'satisfied' END AS terminal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS open_ FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def demand_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end state of each demand from the facts that are there."""
    t = Tables(spark, sf_dir)
    facts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "F").alias("open"))
    terminal = R.cascade((F.col("n").isNull(), "not_required"), (F.col("open") > 0, "evidence_missing"), otherwise="satisfied")
    return t.customer.select("c_custkey").join(facts, "c_custkey", "left").select("c_custkey", terminal.alias("terminal"))
