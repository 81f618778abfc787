"""Trees of markup as rows: tokens, matched tags, numbered intervals, parents and paths, typed facts.

A tree is numbered by the places of its tokens: an element spans from its start
tag to its end tag. Everything follows from windows over the tokens of a text;
no pair of elements is ever listed. All windows are within a text, so one
shuffle by the text's key serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comments, declarations, and elements whose content isn't markup are one token each.
TOKENS = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[a-z/!?][^>]*>|[^<]+|<"
#: Elements that never have an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: The entities that are undone, in this order.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def tokens(df: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, at, token, kind, name): kind is text, start, end, leaf (void or closed in itself) or skip. A null text has no token."""
    cut = df.select(key, F.posexplode(F.regexp_extract_all(F.col(markup), F.lit(TOKENS), F.lit(0))).alias("at", "token"))
    t = F.col("token")
    name = F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9:_-]*)", 1))
    named = cut.withColumn("name", name)
    kind = (
        F.when(~t.rlike("(?s)^<."), "text").when(t.rlike("^<[!?]") | F.col("name").isin("script", "style") | (F.col("name") == ""), "skip").when(t.startswith("</"), "end")
        .when(F.col("name").isin(*VOID) | t.endswith("/>"), "leaf").otherwise("start")
    )
    return named.withColumn("kind", kind)


def matched(found: DataFrame, key: str) -> DataFrame:
    """``tokens`` with until: for start tags and leaves where the element ends, for end tags where it started. Null for end tags
    that close nothing; a start tag that nothing closes is a leaf.

    Tags of one name are matched like brackets: the running level of the name, counted from its lowest
    point so far, says which start an end belongs to.
    """
    of_name = Window.partitionBy(key, "name").orderBy("at")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    run = found.withColumn("run", F.sum(step).over(of_name.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("low", F.least(F.lit(0), F.min("run").over(of_name.rowsBetween(Window.unboundedPreceding, -1))))
    closes_nothing = (F.col("kind") == "end") & (F.col("run") < F.col("low"))
    level = F.when(F.col("kind") == "start", F.col("run") - F.col("low")).when((F.col("kind") == "end") & ~closes_nothing, F.col("run") - F.col("low") + 1)
    of_level = Window.partitionBy(key, "name", "level").orderBy("at")
    paired = run.withColumn("level", level)
    ends = F.when((F.col("kind") == "start") & (F.lead("kind").over(of_level) == "end"), F.lead("at").over(of_level))
    began = F.when(F.col("level").isNotNull(), F.lag("at").over(of_level))
    until = F.when(F.col("kind") == "start", F.coalesce(ends, "at")).when(F.col("kind") == "leaf", F.col("at")).when(F.col("kind") == "end", began)
    return paired.withColumn("until", until).drop("run", "low", "level")


def nested(df: DataFrame, key: str, markup: str, most_depth: int = 200) -> DataFrame:
    """(key, start, until, depth, parent, name, path, tag, text) of every element; text is what stands directly in it.

    Elements that overlap without one holding the other make the text's depths uneven: all its rows then
    have the path null. Deeper elements than ``most_depth`` are an error.
    """
    cut = matched(tokens(df.repartition(key), key, markup).where("kind <> 'skip'"), key)
    opens = F.coalesce((F.col("kind") == "start") & (F.col("until") > F.col("at")), F.lit(False))
    closes = (F.col("kind") == "end") & F.col("until").isNotNull()
    line = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    deep = cut.withColumns({"depth": F.sum(step).over(line) + F.when(opens, 0).otherwise(1), "opens": opens})
    deepest = deep.agg(F.max(F.when(F.col("opens"), F.col("depth")))).first()[0] or 0
    if deepest > most_depth:
        raise ValueError(f"elements are nested {deepest} deep, {most_depth} are allowed")
    levels = range(1, deepest + 1)
    last = lambda k, what: F.last(F.when(F.col("opens") & (F.col("depth") == k), F.col(what)), ignorenulls=True).over(line)
    open_at = deep.withColumns({f"at{k}": last(k, "at") for k in levels} | {f"name{k}": last(k, "name") for k in levels})
    above = F.array(*(F.col(f"at{k}") for k in levels)) if deepest else F.array().cast("array<int>")
    names = F.array(*(F.col(f"name{k}") for k in levels)) if deepest else F.array().cast("array<string>")
    placed = open_at.withColumns({"parent": F.get(above, F.col("depth") - 2), "names": F.slice(names, 1, F.greatest(F.col("depth") - 1, F.lit(0)))})
    # an end closes what was last opened on its level, or elements overlap
    crossed = closes & ~F.col("until").eqNullSafe(F.get(above, F.col("depth") - 1))
    placed = placed.withColumn("bad", F.max(crossed).over(Window.partitionBy(key)))
    text = placed.where("kind = 'text'").groupBy(key, F.col("parent").alias("start")).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("parts"))
    text = text.select(key, "start", unescaped(F.array_join(F.transform("parts", lambda p: p["token"]), "")).alias("text"))
    path = F.concat(F.lit("/"), F.array_join(F.concat("names", F.array("name")), "/"))
    elements = placed.where("kind IN ('start', 'leaf')").select(key, F.col("at").alias("start"), "until", "depth", "parent", "name", F.when(~F.col("bad"), path).alias("path"), F.col("token").alias("tag"))
    return elements.join(text, [key, "start"], "left")


def unescaped(x: Column) -> Column:
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return x


def attribute(tag: Column, name: str) -> Column:
    """The value of a quoted attribute of a start tag; null if it isn't there."""
    return F.when(tag.rlike(rf'(?i)\s{name}="'), unescaped(F.regexp_extract(tag, rf'(?i)\s{name}="([^"]*)"', 1)))


def typed_facts(nodes: DataFrame, key: str, definitions: list[tuple[str, str, str | None, str]]) -> DataFrame:
    """(key, fact, start, value, status) by definitions (fact, end of path, attribute or None for text, pattern of the type).

    status: typed, invalid (a value that isn't of the type) or missing (no value at all). Definitions are a bounded table.
    """
    found = []
    for fact, path, of, pattern in definitions:
        value = F.nullif(F.trim(F.coalesce(attribute(F.col("tag"), of) if of else F.col("text"), F.lit(""))), F.lit(""))
        status = F.when(value.isNull(), "missing").when(value.rlike(pattern), "typed").otherwise("invalid")
        found.append(F.when(F.col("path").endswith(path), F.struct(F.lit(fact).alias("fact"), value.alias("value"), status.alias("status"))))
    facts = nodes.select(key, "start", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return facts.select(key, "f.fact", "start", "f.value", "f.status")
