"""Secret scan through a trigram index: Boolean trigram queries, intersected postings, verified candidates.

Each rule's regular expression is turned into alternatives of trigrams that a
match must contain. A rule with an alternative that has none (a bare run of hex
digits, say) is scanned fully. For the others:

1. ``trigram_index``: one row a trigram and block of documents, with the sorted
   keys of the block's documents that contain it. Blocks are hash ranges of the
   key, of about BLOCK_KEYS keys, so no posting list grows with the corpus. The
   index is a DataFrame: write it once and ask it about other rules later.
2. ``candidates``: the posting lists of an alternative's trigrams are intersected
   block by block, and alternatives united.
3. ``scan``: the texts meet their candidate rules by key, and each rule runs over
   whole candidate texts only. A key is a 64-bit hash; a collision adds a
   candidate, which verification settles, and loses none.

Trigrams are taken from lower-cased text on both sides, so case only adds candidates.

Defined results for odd input: null and empty texts have no secret; null and
repeated ids and repeated rows are each scanned and returned; texts shorter than
three characters are reached by fully scanned rules alone; an empty table gives
no rows. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK_KEYS = 4096
MOST_ALTERNATIVES = 1024
#: A class of up to so many characters is spelled out in the trigram query; a larger one is a gap.
SPELLED_CLASS = 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    """Least number of characters of the measured group."""
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for found in self.compiled().finditer(text):
            if found.end(self.group) - found.start(self.group) >= self.least:
                yield found.span()


#: The base kinds.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
]
#: Further kinds with a fixed form of their own.
FURTHER = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", any_case=True),
]
RULES = BASE + FURTHER


class _Gap:
    """What a trigram can't reach across."""


_GAP = _Gap()


def _joined(parts: list[list[tuple]]) -> list[tuple]:
    """All ways to follow one alternative of each part by one of the next."""
    out = [()]
    for choices in parts:
        if len(out) * len(choices) > MOST_ALTERNATIVES:
            choices = [(_GAP,)]
        out = [a + b for a, b in product(out, choices)]
    return out


def _ways(node) -> list[tuple]:
    """The alternatives of a parsed pattern, each a tuple of characters and gaps. Looser than the pattern, never stricter."""
    ops = re._constants
    parts: list[list[tuple]] = []
    for op, value in node:
        if op is ops.LITERAL:
            parts.append([tuple(chr(value).lower())])
        elif op is ops.IN and all(x is ops.LITERAL for x, _ in value) and len(value) <= SPELLED_CLASS:
            parts.append([(c,) for c in sorted({chr(c).lower() for _, c in value})])
        elif op is ops.BRANCH:
            parts.append([way for branch in value[1] for way in _ways(branch)])
        elif op is ops.SUBPATTERN:
            parts.append(_ways(value[3]))
        elif op is ops.MAX_REPEAT or op is ops.MIN_REPEAT:
            least, most, inner = value
            once = _ways(inner)
            if least == 0:
                parts.append([(), *once] if most == 1 else [(_GAP,)])
            else:
                parts += [once] if least == most == 1 else [once, [(_GAP,)]]
        elif op is ops.AT:
            continue
        else:
            parts.append([(_GAP,)])
    return _joined(parts)


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """Alternatives, each a set of trigrams that a match of it contains; None if a match may contain none."""
    found = set()
    for way in _ways(re._parser.parse(rule.pattern)):
        grams, run = set(), ""
        for c in (*way, _GAP):
            run = "" if c is _GAP else run + c
            if len(run) >= 3:
                grams.add(run[-3:])
        found.add(frozenset(grams))
    if frozenset() in found:
        return None
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.lit(13), F.col(id_col).cast("string"), F.col(text_col))


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, block, keys): the documents of each block whose lower-cased text contains the trigram. trigrams: those of the rules, a bounded list."""
    blocks = max(1, -(-docs.count() // BLOCK_KEYS))
    low = F.lower(F.col(text_col))
    grams = F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams])
    rows = docs.where(F.length(text_col) >= 3).select(_key(id_col, text_col).alias("key"), F.explode(F.array_compact(grams)).alias("trigram"))
    return rows.groupBy("trigram", F.pmod(F.col("key"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_set("key")).alias("keys"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): the documents whose postings fulfil the trigram queries, with the kinds of those rules."""
    spark = index.sparkSession
    clauses = [(kind, number, len(grams), gram) for kind, ways in queries.items() for number, grams in enumerate(ways) for gram in sorted(grams)]
    asked = spark.createDataFrame(clauses, "kind string, clause int, wanted int, trigram string")
    lists = index.join(F.broadcast(asked), "trigram").groupBy("kind", "clause", "wanted", "block").agg(F.collect_list("keys").alias("lists"))
    met = lists.where(F.size("lists") == F.col("wanted")).select(
        "kind", F.explode(F.aggregate(F.slice("lists", 2, MOST_ALTERNATIVES), F.element_at("lists", 1), F.array_intersect)).alias("key")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _scanner(rules: list[Rule], always: list[str]):
    """Spans (kind, start, end) of each text by the rules named beside it and those that always run."""
    always, order = set(always), {r.kind: i for i, r in enumerate(rules)}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = []
            for text, kinds in zip(pdf["text"], pdf["kinds"], strict=True):
                run = always if kinds is None else always.union(kinds)
                own = [(start, order[rule.kind], end) for rule in rules if rule.kind in run for start, end in rule.spans(text)] if text else []
                spans.append([{"kind": rules[i].kind, "start": start, "end": end} for start, i, end in sorted(own)])
            yield pd.DataFrame({"id": pdf["id"], "spans": spans})

    return scan


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every document: code points, end exclusive, by start and then the order of the rules."""
    queries = {r.kind: trigram_query(r) for r in rules}
    full = [kind for kind, ways in queries.items() if ways is None]
    indexed = {kind: ways for kind, ways in queries.items() if ways is not None}
    rows = docs.select(_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if indexed:
        index = trigram_index(docs, sorted({t for ways in indexed.values() for w in ways for t in w}), id_col, text_col)
        rows = rows.join(stored(candidates(index, indexed), "candidates"), "key", "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select("id", "text", "kinds").mapInPandas(_scanner(rules, full), f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")
    return found.withColumnRenamed("id", id_col)


def joined(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of what ``scan`` found."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(id_col, *counts, F.sha2(joined(of(*(r.kind for r in BASE))).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

