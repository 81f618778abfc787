"""Queries of routing, terminal states and rule cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import money
from ..operators import routing as R
from .base import Tables, query

#: (token, domain, kind, weight)
VOCABULARY = [
    ("the", "english", "exact", 100), ("and", "english", "exact", 35), ("thth", "english", "stem", 20), ("der", "german", "exact", 100), ("und", "german", "exact", 35), ("sch", "german", "stem", 20),
    ("les", "french", "exact", 80), ("eaux", "french", "stem", 20), ("los", "spanish", "exact", 80), ("ción", "spanish", "stem", 35),
]
_RULES = "(VALUES " + ", ".join(f"('{t}', '{d}', '{k}', {w})" for t, d, k, w in VOCABULARY) + ") v(token, domain, kind, weight)"
_SCORES = f"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM documents),
h AS (SELECT DISTINCT doc_id, token, domain, weight FROM w JOIN {_RULES} ON (kind = 'exact' AND word = token) OR (kind = 'stem' AND starts_with(word, token))),
s AS (SELECT doc_id, domain, CAST(sum(weight) AS BIGINT) AS score FROM h GROUP BY ALL)"""


@query(f"{_SCORES} SELECT * FROM s")
def token_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.token_scores(Tables(spark, sf_dir).documents, "doc_id", "text", VOCABULARY)


@query(f"""{_SCORES} SELECT doc_id, domain, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS INTEGER) AS rank, CASE WHEN score >= 100 THEN 'high' WHEN score >= 80 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM s) WHERE score >= best - 20 AND score >= 35 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) <= 2""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked_domains(R.token_scores(Tables(spark, sf_dir).documents, "doc_id", "text", VOCABULARY), "doc_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, kind, CAST(amount AS DECIMAL(20,2)) AS amount FROM (
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'disposal' ELSE 'purchase' END AS kind, CAST(l_extendedprice AS DECIMAL(20,2)) AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'discount', CAST(l_discount AS DECIMAL(20,2)) FROM lineitem WHERE l_discount <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', CAST(l_tax AS DECIMAL(20,2)) FROM lineitem WHERE l_tax <> 0)""")
def flat_map_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade row to its main record and one charge for each that isn't zero."""
    record = lambda kind, amount: F.struct(kind.alias("kind"), money(amount).alias("amount"))
    main = record(F.when(F.col("l_returnflag") == "R", "disposal").otherwise("purchase"), F.col("l_extendedprice"))
    charges = F.filter(F.array(record(F.lit("discount"), F.col("l_discount")), record(F.lit("tax"), F.col("l_tax"))), lambda r: r["amount"] != 0)
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.inline(F.concat(F.array(main), charges)))


@query("""SELECT doc_id, 'labelled' AS kind, CAST(quality AS VARCHAR) AS reason FROM labels UNION ALL SELECT doc_id, 'unlabelled', 'no_label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def union_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped rows and, with a reason, the others: nothing is lost."""
    t = Tables(spark, sf_dir)
    mapped = t.labels.select("doc_id", F.lit("labelled").alias("kind"), F.col("quality").cast("string").alias("reason"))
    rest = t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return mapped.unionByName(rest.select("doc_id", F.lit("unlabelled").alias("kind"), F.lit("no_label").alias("reason")))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 200) THEN 'no_fact' WHEN count(DISTINCT CASE WHEN event_type IN ('purchase', 'signup') AND value > 100 THEN event_type END) > 1 THEN 'conflict' WHEN count(CASE WHEN event_type IN ('purchase', 'signup') AND value > 100 THEN 1 END) > 0 THEN 'typed'
WHEN bool_or(event_type = 'view' AND value > 100) THEN 'unknown' WHEN bool_or(event_type = 'click' AND value > 100) THEN 'model_no_fact' ELSE 'uncovered' END AS terminal FROM events GROUP BY user_id""")
def ownership_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.col("value") > 100
    flags = {
        "no_fact": (F.col("event_type") == "error") & (F.col("value") > 200), "typed": F.when(F.col("event_type").isin("purchase", "signup") & high, F.col("event_type")),
        "unknown": (F.col("event_type") == "view") & high, "model_no_fact": (F.col("event_type") == "click") & high,
    }
    return R.ownership(Tables(spark, sf_dir).events, "user_id", flags)


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'required' WHEN quality = 0 THEN 'advisory' ELSE 'none' END AS kind, CAST(row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END, doc_id) AS INTEGER) AS place FROM documents JOIN labels USING (doc_id)""")
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = Tables(spark, sf_dir)
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    kind = R.cascade((F.col("toxic") == 1, "required"), (F.col("quality") == 0, "advisory"), otherwise="none")
    level = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return rows.select("doc_id", kind.alias("kind"), F.row_number().over(Window.partitionBy("lang").orderBy(level, "doc_id")).alias("place"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN contains(text, 'http') AND contains(text, '@') THEN 'contact' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'phone' WHEN n_chars < 120 THEN 'fragment' ELSE 'prose' END AS class,
concat_ws(',', CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, 'http') THEN 'link' END, CASE WHEN contains(text, '|') THEN 'table' END) AS reasons, n_chars < 120 OR lang IS NULL AS review FROM documents""")
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    kind = R.cascade((text.isNull() | (text == ""), "empty"), (text.contains("http") & text.contains("@"), "contact"), (text.rlike("[0-9]{3}-[0-9]{4}"), "phone"), (F.col("n_chars") < 120, "fragment"), otherwise="prose")
    why = R.reasons((text.contains("@"), "mail"), (text.contains("http"), "link"), (text.contains("|"), "table"))
    return Tables(spark, sf_dir).documents.select("doc_id", kind.alias("class"), why.alias("reasons"), ((F.col("n_chars") < 120) | F.col("lang").isNull()).alias("review"))


@query("""SELECT doc_id, contains(text, 'license') OR (CASE WHEN contains(lower(text), 'copyright') THEN 1 ELSE 0 END + CASE WHEN contains(text, '(c)') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'rights') THEN 1 ELSE 0 END) >= 2 AS signalled FROM documents""")
def weak_strong_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One strong or two weak signals."""
    text, low = F.col("text"), F.lower("text")
    weak = sum((x.cast("int") for x in (low.contains("copyright"), text.contains("(c)"), low.contains("rights"))), F.lit(0))
    return Tables(spark, sf_dir).documents.select("doc_id", (text.contains("license") | (weak >= 2)).alias("signalled"))


@query("""SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'empty' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 2 THEN 'packages_incomplete' WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 2 THEN 'labels_incomplete' ELSE 'ready' END AS status FROM orders GROUP BY o_custkey""")
def case_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(R.cascade((of("F") == 0, "empty"), (of("P") > 2, "packages_incomplete"), (of("O") > 2, "labels_incomplete"), otherwise="ready").alias("status"))


@query("""SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'missing' WHEN bool_or(o_orderpriority = '5-LOW') THEN 'partial' ELSE 'found' END AS selection FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def methodology_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    facts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("low"))
    return t.customer.select("c_custkey").join(facts, "c_custkey", "left").select("c_custkey", R.cascade((F.col("n").isNull(), "missing"), (F.col("low"), "partial"), otherwise="found").alias("selection"))


@query("""SELECT o_orderkey, CASE WHEN concat_ws(',', CASE WHEN o_totalprice > 480000 THEN 'too_large' END) <> '' THEN 'unsupported' WHEN o_orderpriority = '1-URGENT' THEN 'review' WHEN o_orderstatus = 'P' THEN 'blocked' ELSE 'accepted' END AS state,
concat_ws(',', CASE WHEN o_totalprice > 480000 THEN 'too_large' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS codes FROM orders""")
def table_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates with reason codes, and the state by priority."""
    large, urgent, pending = F.col("o_totalprice") > 480000, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P"
    return Tables(spark, sf_dir).orders.select("o_orderkey", R.cascade((large, "unsupported"), (urgent, "review"), (pending, "blocked"), otherwise="accepted").alias("state"), R.reasons((large, "too_large"), (urgent, "urgent"), (pending, "pending")).alias("codes"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity IS NULL THEN 'role_incomplete' ELSE 'complete' END AS roles, CAST(CAST(l_extendedprice AS DECIMAL(20,2)) - CAST(round(CAST(l_extendedprice AS DECIMAL(20,2)) * CAST(l_discount AS DECIMAL(5,4)), 2) AS DECIMAL(20,2)) AS DECIMAL(20,2)) AS net FROM lineitem""")
def net_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proceeds less costs, in exact decimals."""
    price = money(F.col("l_extendedprice"))
    cost = F.round(price * F.col("l_discount").cast("decimal(5,4)"), 2).cast("decimal(20,2)")
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", R.cascade((F.col("l_quantity").isNull(), "role_incomplete"), otherwise="complete").alias("roles"), (price - cost).cast("decimal(20,2)").alias("net"))
