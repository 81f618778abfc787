"""Keeping and checking records: sealed packages, flattened facts, batch status, artifact chains, activation, arbitration, provenance."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import saved


class Package:
    """A store of records by document that is written bit by bit, sealed once, and read from then on.

    Each append is a folder of its own and its documents' rows are dealt out by a hash of the document, so nothing is held in memory
    and a lost executor's attempt leaves nothing. Sealing writes the index (document, records, first, last, checksum); what was appended
    after that can't be, and reading before it can't either.
    """

    def __init__(self, spark: SparkSession, root: str, document: str, order: str):
        self.spark, self.root, self.document, self.order = spark, root.rstrip("/"), document, order
        self.parts: list[str] = []
        self.sealed = False

    def append(self, rows: DataFrame) -> None:
        if self.sealed:
            raise ValueError("the package is sealed")
        path = f"{self.root}/part={len(self.parts):06d}"
        rows.repartition(self.document).sortWithinPartitions(self.document, self.order).write.parquet(path)
        self.parts.append(path)

    def seal(self) -> DataFrame:
        if self.sealed:
            raise ValueError("the package is sealed already")
        rows = self.spark.read.parquet(*self.parts)
        checksum = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(self.order, "__hash"))), lambda x: x["__hash"]), "").cast("binary"), 256)
        hashed = rows.withColumn("__hash", F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256))
        index = hashed.groupBy(self.document).agg(F.count("*").alias("records"), F.min(self.order).alias("first"), F.max(self.order).alias("last"), checksum.alias("checksum"))
        index.write.parquet(f"{self.root}/index")
        self.sealed = True
        return self.spark.read.schema(index.schema).parquet(f"{self.root}/index")

    def read(self, documents: DataFrame | None = None) -> DataFrame:
        """All records, or those of some documents."""
        if not self.sealed:
            raise ValueError("the package isn't sealed yet")
        rows = self.spark.read.parquet(*self.parts)
        return rows if documents is None else rows.join(documents.select(self.document).distinct(), self.document, "left_semi")


def flattened(facts: DataFrame, roles: str = "roles") -> DataFrame:
    """Facts with what they are looked up by as columns: asset (the first one among the roles), day (of an ISO date among them) and payload, the roles as JSON."""
    first = lambda role: F.get(F.transform(F.filter(roles, lambda r: r["role"] == role), lambda r: r["value"]), 0)
    day = F.when(first("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(first("date"), "yyyy-MM-dd"))
    return facts.withColumns({"asset": first("asset"), "day": day, "payload": F.to_json(roles)}).drop(roles)


def batch_status(records: DataFrame, key: str, status: str, failed: tuple[str, ...] = ("failed",), waiting: tuple[str, ...] = ("pending",)) -> DataFrame:
    """One row (records, repeated, counts, overall, checksum): the checksum is over key and status in the order of the keys.

    overall: invalid if a key is repeated, else failed, pending, partial (some failed) or complete. The checksum is a sum of hashes, so no list of all
    records is gathered anywhere; it doesn't depend on their order.
    """
    own = records.groupBy(key).agg(F.count("*").alias("n"), F.min(status).alias("status"))
    kinds = own.groupBy("status").agg(F.count("*").alias("keys"), F.sum("n").alias("records"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.pmod(F.crc32(F.concat_ws("|", F.col(key).cast("string"), "status").cast("binary")), F.lit(1 << 31))).alias("digest"))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "keys"))), lambda x: F.concat_ws(":", x["status"], x["keys"].cast("string"))), ",")
    some = lambda names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("keys"))), F.lit(0))
    total = F.coalesce(F.sum("keys"), F.lit(0))
    overall = F.when(F.coalesce(F.sum("repeated"), F.lit(0)) > 0, "invalid").when((some(failed) == total) & (total > 0), "failed").when(some(waiting) > 0, "pending").when(some(failed) > 0, "partial").otherwise("complete")
    return kinds.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated"), counts.alias("counts"), overall.alias("overall"), F.coalesce(F.sum("digest"), F.lit(0)).alias("checksum"))


def looked_up(observations: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Each record that an observation has, and observations without one with the status ``missing``; records of no observation are ``unobserved``."""
    both = observations.withColumn("__seen", F.lit(True)).join(records.withColumn("__kept", F.lit(True)), key, "full")
    status = F.when(F.col("__kept").isNull(), "missing").when(F.col("__seen").isNull(), "unobserved").otherwise("found")
    return both.withColumn("status", status).drop("__seen", "__kept")


def latest(puts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last put of each key, without those that it deletes (a column ``deleted``)."""
    last = puts.groupBy(key).agg(F.max_by(F.struct(*puts.columns), F.struct(*order)).alias("__row"))
    return last.select("__row.*").where(~F.coalesce(F.col("deleted"), F.lit(False)))


def chains(artifacts: DataFrame, edges: DataFrame, key: str, most_depth: int = 100) -> DataFrame:
    """(key, ancestor, depth): all that each artifact was made from, through edges (parent, child), at the least depth. Edges to artifacts that are gone lead nowhere.

    Levels are written tables, each written once; a level is a join with the edges and an anti-join with those before, so cycles end. Where
    no artifact has two parents, only a cycle can meet a pair again; then levels are joins alone, and those that don't end within
    ``most_depth`` are done again with anti-joins. Deeper chains than ``most_depth`` are an error.
    """
    there = artifacts.select(key)
    alive = saved(edges.join(there.withColumnRenamed(key, "child"), "child", "left_semi").join(there.withColumnRenamed(key, "parent"), "parent", "left_semi").select("parent", "child").distinct())
    first = alive.select(F.col("child").alias(key), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    one_parent = alive.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    for alone in (True, False)[not one_parent :]:
        levels = [first]
        for depth in range(2, most_depth + 2):
            above = levels[-1].select(key, F.col("ancestor").alias("child")).join(alive, "child").select(key, F.col("parent").alias("ancestor"))
            if not alone:
                above = above.distinct().join(reduce(DataFrame.unionByName, levels), [key, "ancestor"], "left_anti")
            level = saved(above.withColumn("depth", F.lit(depth)))
            if level.isEmpty():
                return reduce(DataFrame.unionByName, levels)
            levels.append(level)
    raise ValueError(f"a chain is longer than {most_depth}")


def activated(versions: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """``versions`` (key, version, state) after activations (key, version, expected): compare and set, for each key at once.

    An activation takes effect if ``expected`` is the key's active version (null: none is) and its own version is validated, or superseded, which is a
    rollback; the version active till then is superseded. Of several activations of a key none takes effect. outcome, on each row of the key: applied, stale,
    not_ready, contested, or null without an activation.
    """
    now = versions.groupBy(key).agg(F.max(F.when(F.col("state") == "active", F.col("version"))).alias("__active"))
    one = asked.groupBy(key).agg(F.count("*").alias("__n"), F.min("version").alias("__to"), F.min("expected").alias("__expected"))
    ready = versions.where("state IN ('validated', 'superseded')").select(key, F.col("version").alias("__to"), F.lit(True).alias("__ready")).distinct()
    plan = one.join(now, key, "left").join(ready, [key, "__to"], "left")
    outcome = F.when(F.col("__n") > 1, "contested").when(~F.col("__active").eqNullSafe(F.col("__expected")), "stale").when(F.col("__ready").isNull(), "not_ready").otherwise("applied")
    out = versions.join(plan.select(key, "__to", outcome.alias("outcome")), key, "left")
    applied = F.coalesce(F.col("outcome") == "applied", F.lit(False))
    state = F.when(applied & (F.col("version") == F.col("__to")), "active").when(applied & (F.col("state") == "active"), "superseded").otherwise(F.col("state"))
    return out.select(key, "version", state.alias("state"), "outcome")


def arbitrated(signals: dict[str, DataFrame], key: str, rules: DataFrame, otherwise: str = "undecided") -> DataFrame:
    """(key, status, rule) from several tables of signals (key, signal) by a table of rules (rule, status, source columns), the least rule that fits.

    Each source has one signal a key, or none, which is the signal ``absent``; a rule names a signal for each source, null for any. Rules are a bounded table.
    """
    both: DataFrame | None = None
    for name, df in signals.items():
        own = df.groupBy(key).agg(F.when(F.count_distinct("signal") > 1, "conflict").otherwise(F.min("signal")).alias(name))
        both = own if both is None else both.join(own, key, "full")
    filled = both.fillna("absent", list(signals))
    r = F.broadcast(rules.select("rule", "status", *(F.col(n).alias(f"__{n}") for n in signals)))
    fits = [F.col(f"__{n}").isNull() | (F.col(f"__{n}") == F.col(n)) for n in signals]
    condition = fits[0]
    for f in fits[1:]:
        condition = condition & f
    # every signal is one of few, so the combinations are joined, not the keys
    kinds = filled.select(*signals).distinct()
    chosen = kinds.join(r, condition, "left").groupBy(*signals).agg(F.min_by("status", "rule").alias("status"), F.min("rule").alias("rule"))
    return filled.join(chosen, list(signals)).select(key, F.coalesce("status", F.lit(otherwise)).alias("status"), "rule")


def provenance_differences(rows: DataFrame, stated: dict[str, Column], key: str) -> DataFrame:
    """(key, field, stated, derived) of the fields whose stated value isn't the one derived anew; stated: by field, the expression that derives it."""
    parts = [F.when(~F.col(name).eqNullSafe(derived), F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("stated"), derived.cast("string").alias("derived"))) for name, derived in stated.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*parts))).alias("d")).select(key, "d.*")


def accounted(candidate: DataFrame, submitted: DataFrame, cell: list[str], value: str) -> DataFrame:
    """(cell, status): every cell of the candidate has to be submitted exactly once. missing, repeated, unknown (no such cell), changed, same."""
    own = submitted.groupBy(*cell).agg(F.count("*").alias("__n"), F.min(value).alias("__value"))
    both = candidate.select(*cell, F.col(value).alias("__own"), F.lit(True).alias("__there")).join(own, cell, "full")
    status = F.when(F.col("__there").isNull(), "unknown").when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "repeated").when(F.col("__own").eqNullSafe(F.col("__value")), "same").otherwise("changed")
    return both.select(*cell, status.alias("status"))


def demand_metrics(demands: DataFrame, facts: DataFrame, key: str, kind: str, usable: Callable[[], Column]) -> DataFrame:
    """(kind, demands, satisfied, cause counts) of demands (key, kind): satisfied by a usable fact of the key and kind, else for the cause wrong_kind, unusable or no_fact."""
    fit = F.coalesce(usable(), F.lit(False))
    own = facts.groupBy(key, kind).agg(F.bool_or(fit).alias("__usable"), F.lit(True).alias("__own"))
    any_ = facts.groupBy(key).agg(F.lit(True).alias("__any"))
    met = demands.join(own, [key, kind], "left").join(any_, key, "left")
    cause = F.when(F.col("__usable"), "satisfied").when(F.col("__own"), "unusable").when(F.col("__any"), "wrong_kind").otherwise("no_fact")
    named = met.withColumn("cause", cause)
    return named.groupBy(kind).agg(F.count("*").alias("demands"), *(F.count_if(F.col("cause") == c).alias(c) for c in ("satisfied", "unusable", "wrong_kind", "no_fact")))
