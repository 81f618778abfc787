"""Routing of rows to domains and terminal states, and rule cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The outcome of the first rule that holds; a null condition doesn't hold."""
    out = F.lit(otherwise)
    for condition, outcome in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), outcome).otherwise(out)
    return out


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that hold, joined in order."""
    return F.concat_ws(",", *(F.when(condition, F.lit(name)) for condition, name in rules))


def token_scores(rows: DataFrame, key: str, text: str, vocabulary: list[tuple[str, str, str, int]]) -> DataFrame:
    """(key, domain, score): words of a text against (token, domain, exact or stem, weight) rules; each rule counts once a text.

    The rules are a constant, so a row's words are matched where they stand: a rule's number is looked up by the word and
    by its leading parts of the stems' lengths, and nothing is shuffled before the sum. Rows of one key are one text.
    """
    numbered = {kind: {} for kind in ("exact", "stem")}
    for i, (token, _, kind, _) in enumerate(vocabulary):
        numbered[kind].setdefault(token, []).append(i)
    lengths = sorted({len(t) for t in numbered["stem"]})

    def look(kind: str, word: Column) -> Column:
        out = F.lit(None).cast("array<int>")
        if numbered[kind]:
            out = F.element_at(F.create_map(*(x for t, own in numbered[kind].items() for x in (F.lit(t), F.array(*map(F.lit, own))))), word)
        return F.coalesce(out, F.array().cast("array<int>"))

    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    wanted = F.filter(words, lambda w: (w != "") & (w.isin(list(numbered["exact"])) | (F.substring(w, 1, lengths[0]).isin(sorted({t[: lengths[0]] for t in numbered["stem"]})) if lengths else F.lit(False))))
    hits = F.flatten(F.transform(wanted, lambda w: F.concat(look("exact", w), *(look("stem", F.when(F.length(w) >= n, F.substring(w, 1, n))) for n in lengths))))
    found = rows.select(key, F.explode(F.array_distinct(hits)).alias("__rule"))
    domain, weight = F.array(*(F.lit(v[1]) for v in vocabulary)), F.array(*(F.lit(v[3]) for v in vocabulary))
    return found.groupBy(key, F.get(domain, F.col("__rule")).alias("domain")).agg(F.sum(F.get(weight, F.col("__rule"))).alias("score"))


def ranked_domains(scores: DataFrame, key: str, within: int = 20, least: int = 35, most: int = 2) -> DataFrame:
    """Domains within ``within`` of the best score and of ``least`` at least, the first ``most`` by score, then name; with a confidence."""
    w = Window.partitionBy(key)
    best = F.max("score").over(w)
    kept = scores.withColumn("best", best).where((F.col("score") >= F.col("best") - within) & (F.col("score") >= least))
    ranked = kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "domain"))).where(F.col("rank") <= most)
    confidence = cascade((F.col("score") >= 100, "high"), (F.col("score") >= 80, "medium"), otherwise="low")
    return ranked.withColumn("confidence", confidence).drop("best")


def ownership(refs: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """(key, terminal): each ref ends in one state. flags: no_fact, typed (a type or null), unknown, model_no_fact."""
    agg = refs.groupBy(key).agg(
        F.bool_or(flags["no_fact"]).alias("no_fact"), F.min(flags["typed"]).alias("least"), F.max(flags["typed"]).alias("most"),
        F.bool_or(flags["unknown"]).alias("unknown"), F.bool_or(flags["model_no_fact"]).alias("model_no_fact"),
    )
    terminal = cascade(
        (F.col("no_fact"), "no_fact"), (F.col("least") != F.col("most"), "conflict"), (F.col("least").isNotNull(), "typed"),
        (F.col("unknown"), "unknown"), (F.col("model_no_fact"), "model_no_fact"), otherwise="uncovered",
    )
    return agg.select(key, terminal.alias("terminal"))
