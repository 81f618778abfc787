"""Queries of order-dependent operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import money
from ..operators import sequences as S
from ..sources.store import saved
from .base import Tables, query


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(Tables(spark, sf_dir).events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.islands(Tables(spark, sf_dir).events, "user_id", ["ts", "event_id"], F.col("event_type"))
    return rows.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.any_value("event_type").alias("event_type"), F.count("*").alias("n"))


_SPANS = "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS low, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS high FROM lineitem"


@query(f"""SELECT l_suppkey, count(DISTINCT d) AS days FROM (SELECT l_suppkey, unnest(generate_series(low, high, INTERVAL 1 DAY)) AS d FROM ({_SPANS})) GROUP BY l_suppkey""")
def interval_union_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("l_shipdate").cast("date")
    spans = Tables(spark, sf_dir).lineitem.select("l_suppkey", low.alias("low"), F.date_add(low, F.col("l_linenumber")).alias("high"))
    return S.covered_days(spans, "l_suppkey", "low", "high")


@query(f"""WITH s AS ({_SPANS}), m AS (SELECT *, max(high) OVER (PARTITION BY l_suppkey ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s), i AS (SELECT *, sum(CASE WHEN top >= low THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT l_suppkey, min(low) AS begin, max(high) AS "end", count(*) AS n FROM i GROUP BY l_suppkey, k""")
def band_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("l_shipdate").cast("date")
    spans = Tables(spark, sf_dir).lineitem.select("l_suppkey", low.alias("low"), F.date_add(low, F.col("l_linenumber")).alias("high"))
    return S.interval_islands(spans, "l_suppkey", "low", "high")


_LOTS = "SELECT l_partkey, l_orderkey * 10 + l_linenumber AS lot, min(CAST(l_shipdate AS DATE)) AS d, CAST(max(l_quantity) AS BIGINT) AS q, min(l_returnflag) AS side FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY ALL"


@query(f"""WITH r AS ({_LOTS}), c AS (SELECT *, sum(q) OVER (PARTITION BY l_partkey, side ORDER BY d, lot ROWS UNBOUNDED PRECEDING) AS hi FROM r)
SELECT b.l_partkey, b.lot AS buy_ref, s.lot AS sell_ref, CAST(least(b.hi, s.hi) - greatest(b.hi - b.q, s.hi - s.q) AS BIGINT) AS matched FROM c b JOIN c s ON b.l_partkey = s.l_partkey AND b.side = 'N' AND s.side = 'R' AND b.hi - b.q < s.hi AND s.hi - s.q < b.hi""")
def fifo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots first in, first out: flag N buys, flag R sells, by part."""
    lots = _lots(spark, sf_dir)
    found = S.fifo_matches(lots, "l_partkey", ["d"], F.col("side") == "N", "q", "lot").drop("rest")
    return found.withColumn("matched", F.col("matched").cast("long"))


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Tables(spark, sf_dir).lineitem.where("l_returnflag IN ('N', 'R')").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lot"), F.col("l_shipdate").cast("date").alias("d"), "l_quantity", "l_returnflag")
    return lines.groupBy("l_partkey", "lot").agg(F.min("d").alias("d"), F.max("l_quantity").cast("long").alias("q"), F.min("l_returnflag").alias("side"))


@query(f"""SELECT l_partkey, CAST(sum(CASE WHEN side = 'N' THEN q ELSE 0 END) AS BIGINT) AS bought, CAST(sum(CASE WHEN side = 'R' THEN q ELSE 0 END) AS BIGINT) AS sold, CAST(greatest(sum(CASE WHEN side = 'R' THEN q ELSE -q END), 0) AS BIGINT) AS uncovered FROM ({_LOTS}) GROUP BY l_partkey""")
def basis_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.basis_gaps(_lots(spark, sf_dir), "l_partkey", F.col("side") == "N", "q")


@query("""WITH b(i, lo, hi, base, rate) AS (VALUES (0, 0, 100000, 0, 0.13), (1, 100000, 300000, 13000, 0.15), (2, 300000, NULL, 43000, 0.22))
SELECT o_orderkey, CAST(round(coalesce(base + (CAST(o_totalprice AS DECIMAL(20,2)) - lo) * CAST(rate AS DECIMAL(5,4)), 0), 0) AS DECIMAL(20,0)) AS tax, CAST(i AS INTEGER) AS band FROM orders LEFT JOIN b ON CAST(o_totalprice AS DECIMAL(20,2)) > lo AND (hi IS NULL OR CAST(o_totalprice AS DECIMAL(20,2)) <= hi)""")
def rate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", money(F.col("o_totalprice")).alias("base"))
    return orders.select("o_orderkey", *S.band_charge(orders, "base", [("0", "100000", "0.13"), ("100000", "300000", "0.15"), ("300000", None, "0.22")]))


_EDGES = "SELECT DISTINCT user_id AS a, CAST(json_extract(props, '$.k') AS BIGINT) + 1000000 AS b FROM events"


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_EDGES}) UNION SELECT b, a FROM ({_EDGES})), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages (users) that share a source (k), and what those share, transitively."""
    edges = Tables(spark, sf_dir).events.select(F.col("user_id").alias("a"), (F.get_json_object("props", "$.k").cast("long") + 1_000_000).alias("b")).distinct()
    return S.connected(edges, saved)


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), p AS (SELECT *, CAST(ceil(n / 12.0) AS BIGINT) AS parts FROM s)
SELECT user_id, event_id, CAST(CASE WHEN k < (n % parts) * (n // parts + 1) THEN k // (n // parts + 1) ELSE n % parts + (k - (n % parts) * (n // parts + 1)) // (n // parts) END AS BIGINT) AS range FROM p""")
def balanced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.balanced_ranges(Tables(spark, sf_dir).events.select("user_id", "event_id"), "user_id", ["event_id"], 12)


@query("SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS dense FROM events WHERE event_type <> 'error'")
def dense_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.dense_ordinals(Tables(spark, sf_dir).events.select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error")
    return rows.select("user_id", "event_id", F.col("dense").cast("long").alias("dense"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_rows FROM conversations")
def window_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.length("text").alias("size"))
    return S.offset_concat(rows, "conv_id", "turn", "size").select("conv_id", "turn", F.col("offset").cast("long").alias("offset_rows"))


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, size AS filled, 0 AS bin FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.turn, o.k, CASE WHEN r.filled > 0 AND r.filled + o.size > 1500 THEN o.size ELSE r.filled + o.size END, CASE WHEN r.filled > 0 AND r.filled + o.size > 1500 THEN r.bin + 1 ELSE r.bin END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1) SELECT conv_id, turn, CAST(bin AS INTEGER) AS bin FROM r""")
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order, a new chunk where one doesn't fit into 1500 characters."""
    return S.greedy_bins(Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.length("text").alias("size")), "conv_id", "turn", "size", 1500)


@query("""WITH RECURSIVE o AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM part),
r AS (SELECT p_brand, x, k, [x] AS total, [1] AS n, 1 AS own FROM o WHERE k = 1 UNION ALL SELECT p_brand, x, k, CASE WHEN own > len(total) THEN list_append(total, x) ELSE list_transform(total, lambda t, i: CASE WHEN i = own THEN t + x ELSE t END) END,
CASE WHEN own > len(total) THEN list_append(n, 1) ELSE list_transform(n, lambda t, i: CASE WHEN i = own THEN t + 1 ELSE t END) END, own FROM (SELECT o.p_brand, o.x, o.k, r.total, r.n, CAST(coalesce(list_min(list_filter(generate_series(1, len(r.total)), lambda i: abs(o.x - r.total[i] / r.n[i]) <= 3.0)), len(r.total) + 1) AS INTEGER) AS own FROM r JOIN o ON o.p_brand = r.p_brand AND o.k = r.k + 1))
SELECT p_brand, x, CAST(own - 1 AS INTEGER) AS cluster FROM r""")
def axis_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a brand clustered by running mean."""
    return S.running_mean_clusters(Tables(spark, sf_dir).part.select("p_brand", F.col("p_size").cast("double").alias("x")), "p_brand", "x", 3.0)


@query("""WITH RECURSIVE o AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part),
r AS (SELECT p_brand, p_partkey, k, [[x]] AS lines, 1 AS own FROM o WHERE k = 1 UNION ALL SELECT p_brand, p_partkey, k, CASE WHEN own > len(lines) THEN list_append(lines, [x]) ELSE list_transform(lines, lambda l, i: CASE WHEN i = own THEN list_append(l, x) ELSE l END) END, own
FROM (SELECT o.p_brand, o.p_partkey, o.k, o.x, r.lines, CAST(coalesce(list_max(list_filter(generate_series(1, len(r.lines)), lambda i: abs(o.x - list_sort(r.lines[i])[len(r.lines[i]) // 2 + 1]) <= 2.0)), len(r.lines) + 1) AS INTEGER) AS own FROM r JOIN o ON o.p_brand = r.p_brand AND o.k = r.k + 1))
SELECT p_brand, p_partkey, CAST(own - 1 AS INTEGER) AS line FROM r""")
def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page to lines by running median of their tops (sizes stand in)."""
    return S.median_lines(Tables(spark, sf_dir).part.select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("top")), "p_brand", "top", "p_partkey", 2.0)


@query("""WITH l AS (SELECT user_id, event_id, epoch(ts) / 3600 AS t, epoch(ts) / 3600 + 1 AS b FROM events), m AS (SELECT *, CASE WHEN t - lag(b) OVER (PARTITION BY user_id ORDER BY t, b) > 12 THEN 1 ELSE 0 END AS fresh FROM l)
SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY t, b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM m""")
def gap_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600
    rows = S.gap_blocks(Tables(spark, sf_dir).events.select("user_id", "event_id", hour.alias("t"), (hour + 1).alias("b")), "user_id", "t", "b")
    return rows.select("user_id", "event_id", F.col("block").cast("long").alias("block"))
