"""URL filter: rules on hosts and paths, else empirical-Bayes host reputation.

Rules: the longest rule whose host is the page's host or a parent domain of it,
and whose path the page's path starts with, decides.

Reputation: labelled page outcomes (good or bad) are counted by host,
registered domain and suffix. At each level a beta prior centred on the
parent's posterior mean shrinks the observed rate; its strength is estimated by
the method of moments from the spread of the rates of that level over all
outcomes. A page is blocked if the upper posterior bound (normal
approximation) of its host's good rate stays below a cutoff.

Everything is DataFrame work; hosts are aggregated before any join, so a host
with a third of all pages is one row on the reputation side.

Defined results for odd input: a null url, or one without ``://``, has empty
host and path, fits no rule and gets the verdict of the overall prior; without
outcomes every unruled page is allowed; null outcomes are ignored; repeated
rows are judged, and their outcomes counted, each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which names are registered, as in co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
WEAK, STRONG = 1.0, 10_000.0
Z = 2.0
CUTOFF = 0.5


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host and path."""
    rest = F.expr("CASE WHEN instr(__url, '://') > 0 THEN substring(__url, instr(__url, '://') + 3) ELSE '' END")
    return (
        pages.withColumn("__url", F.coalesce(F.col(url_col), F.lit("")))
        .withColumn("__rest", rest)
        .withColumns({"host": F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER), "path": F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)})
        .drop("__url", "__rest")
    )


def suffix_of(host: Column) -> Column:
    """The last label, or the last two if the last but one is a registry's."""
    labels = F.split(host, r"\.")
    two = (F.size(labels) > 2) & F.element_at(labels, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(two, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it; the host itself if it has no more."""
    suffix = suffix_of(host)
    labels = F.split(host, r"\.")
    keep = F.size(F.split(suffix, r"\.")) + 1
    return F.when(F.size(labels) <= keep, host).otherwise(F.array_join(F.slice(labels, F.size(labels) - keep + 1, keep), "."))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits. rules: (host/path, verdict), a bounded list."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        choice = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def _strength(groups: DataFrame, parent: str) -> float:
    """Pseudo-counts of the beta prior of a level: method of moments over groups of (n, good), each against its parent's mean."""
    p = F.col(parent)
    row = groups.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2)).alias("spread"), F.sum(F.col("n") * p * (1 - p)).alias("within"),
    ).first()
    if not row["k"] or row["k"] < 2:
        return STRONG
    within = row["within"] / row["n"]
    between = (row["spread"] - (row["k"] - 1) * within) / (row["n"] - row["n2"] / row["n"])
    return STRONG if between <= 0 else min(STRONG, max(WEAK, within / between - 1))


def host_reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, good_mean, good_upper) for every row of ``hosts`` (host), from ``outcomes`` (host, good as 0 or 1)."""
    seen = outcomes.where("good IS NOT NULL AND host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    total = seen.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = (total["good"] + 1) / (total["n"] + 2) if total["n"] else None
    known = hosts.unionByName(seen.select("host")).distinct().join(seen, "host", "left").na.fill(0, ["n", "good"])
    known = stored(known.withColumns({"suffix": suffix_of(F.col("host")), "domain": domain_of(F.col("host"))}), "hosts")
    if overall is None:
        return known.select("host", F.lit(1.0).alias("good_mean"), F.lit(1.0).alias("good_upper"))
    shrunk = lambda parent, k: (F.col("good") + k * F.col(parent)) / (F.col("n") + k)
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    suffixes = known.groupBy("suffix").agg(*sums).withColumn("parent", F.lit(overall))
    suffixes = suffixes.withColumn("suffix_mean", shrunk("parent", _strength(suffixes, "parent"))).select("suffix", "suffix_mean")
    domains = known.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = domains.withColumn("domain_mean", shrunk("suffix_mean", _strength(domains, "suffix_mean"))).select("domain", "domain_mean")
    judged = known.join(domains, "domain")
    k = _strength(judged, "domain_mean")
    mean = shrunk("domain_mean", k)
    return judged.select("host", mean.alias("good_mean"), (mean + Z * F.sqrt(mean * (1 - mean) / (F.col("n") + k + 1))).alias("good_upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, good_mean, good_upper) of every page. outcomes: (url, good)."""
    urls = parsed(pages.select(id_col, F.col(url_col).alias("url")))
    reputation = host_reputation(urls.select("host").distinct(), parsed(outcomes.select("url", "good")).select("host", "good"))
    chosen = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("good_upper") < CUTOFF, "block").otherwise("allow")
    return urls.withColumn("chosen", chosen).join(reputation, "host", "left").select(id_col, "host", "path", F.col("chosen.rule").alias("rule"), F.coalesce("chosen.verdict", own).alias("verdict"), "good_mean", "good_upper")
