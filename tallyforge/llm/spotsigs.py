"""Document fingerprints from spot signatures, in DataFrame functions only.

A text's words are runs of letters and digits, lower-cased. Common words of the
corpus's languages are the anchors; every anchor, with the chain of the next CHAIN content words (those
that are no anchors), is a signature, hashed to 64 bits. The fingerprint is the
sorted set of a text's signatures, written as hexadecimal digits. Two sets are
compared by Jaccard likeness. For a least likeness asked for, sets are partitioned
by length so that those more than a partition apart can't reach it, a pair within
reach is pruned if even the smaller set as part of the larger couldn't, and only
what is left is intersected; without one, every likeness is exact.

The position of an anchor less the number of anchors before it is the number of
content words before it, so chains are slices and a text costs linear time.

Neighbours in order of the id (then of a hash of the text): a sample of
the rows' keys, some for each range, cuts them into ranges of about RANGE_BYTES of text, at most
MOST_RANGES, as larger ranges only mean longer sorts. The cuts are one constant of the plan, and a row finds its
range among them by bisection. A window within each range takes the following row, and a
copy of each range's first row, one row a range, stands at the end of the range before it.
Texts are shuffled once; signatures are computed behind the shuffle.

Defined results for odd input: null texts are empty and have the empty
fingerprint; a text without anchors has the chains of all its words, one
without content words a signature of itself; two empty sets have likeness 1,
an empty and another one 0; null ids come first; rows of equal ids are ordered by
a hash of the text; a table of one row is its own neighbour; an empty table gives
no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, let, shuffle_partitions

CHAIN = 3
RANGE_BYTES = 32 << 20
KEYS_A_RANGE, MOST_RANGES = 16, 1 << 16
#: Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to a in is that it for was on with be by as this are at from or an not have had but which you were his her they "
    "der die und den von zu das mit sich auf des für ist nicht dem im ein als eine auch es an er so dass kann "
    "de la le et les en un du une que pour est qui par dans sur au pas avec il ce ne se plus ou son "
    "el y los del las por no con su para al lo como más pero sus o este sí"
).split()


def signatures(text: Column, chain: int = CHAIN, common: tuple[str, ...] | list[str] = COMMON_WORDS) -> Column:
    """The sorted distinct signatures of a text (not null), array of long."""
    common = list(dict.fromkeys(common))

    def of_words(words: Column) -> Column:
        content = F.filter(words, lambda w: ~w.isin(common))
        anchors = F.filter(F.transform(words, lambda w, i: F.when(w.isin(common), i)), lambda i: i.isNotNull())

        def chains(content: Column) -> Column:
            spots = F.transform(anchors, lambda i, j: F.when(i - j < F.size(content), F.xxhash64(F.get(words, i), F.slice(content, i - j + 1, chain))))
            return let(F.filter(spots, lambda h: h.isNotNull()), lambda found: F.when(F.size(found) > 0, found).otherwise(F.transform(content, lambda w, k: F.xxhash64(F.slice(content, k + 1, chain)))))

        return let(content, chains)

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    found = let(words, of_words)
    return let(found, lambda x: F.when((F.size(x) > 0) | (text == ""), F.sort_array(F.array_distinct(x))).otherwise(F.array(F.xxhash64(text))))


def as_text(signature_set: Column) -> Column:
    """The fingerprint: sixteen hexadecimal digits for each signature."""
    return F.lower(F.array_join(F.transform(signature_set, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def length_partition(size: Column, least: float) -> Column:
    """Sets whose partitions differ by more than one have a likeness below ``least``."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(math.log(1 / least)))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; 0 for pairs that can't reach ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = F.abs(length_partition(F.size(a), least) - length_partition(F.size(b), least)) > 1 if least else F.lit(False)
    exact = let(F.size(F.array_intersect(a, b)), lambda common: common / (F.size(a) + F.size(b) - common))
    return F.when(large == 0, 1.0).when((small == 0) | apart | (small < large * least), 0.0).otherwise(exact)


def range_starts(rows: DataFrame, key: Column, ranges: int) -> list:
    """The first key of each range, ascending: the least one, and keys of the table that a bounded sample cuts at."""
    keys = rows.select(key.alias("key"))
    low = keys.agg(F.min("key").alias("low")).first()["low"]
    sample = hash_sample(keys.select("key.*"), ["own", "hash"], ranges * KEYS_A_RANGE).collect()
    sample.sort(key=lambda k: (k["keyed"], k["own"] if k["keyed"] else 0, k["hash"]))
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    return [low, *(k for k in dict.fromkeys(cuts) if k != low)]


def with_next(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """``rows`` (id, text) with hash, range, guest and next_text, the text of the following row by ascending (id, hash of
    text); after the last, of the first. Guests are copies of the first row of the following range, to be left out in the end."""
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(shuffle_partitions(rows.sparkSession), -(-size // RANGE_BYTES))
    key = F.struct(F.col("id").isNotNull().alias("keyed"), F.col("id").alias("own"), F.xxhash64("text").alias("hash"))
    starts = range_starts(rows, key, min(ranges, MOST_RANGES))
    if starts[0] is None:  # no rows
        return rows.select("*", F.xxhash64("text").alias("hash"), F.lit(0).alias("range"), F.lit(False).alias("guest"), F.lit(None).cast("string").alias("next_text"))
    shape = f"array<struct<keyed:boolean,own:{rows.schema['id'].dataType.simpleString()},hash:bigint>>"
    firsts = F.from_json(F.lit(json.dumps([k.asDict() for k in starts], default=str)), shape)
    # ranges begin at a key not greater than the row's own: steps that halve lead to the last such one
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(starts).bit_length()))))
    place = lambda own: let(firsts, lambda f: F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(f, at + step) <= own, at + step).otherwise(at)))
    dealt = rows.select("*", F.xxhash64("text").alias("hash"), let(key, place).alias("range"), F.lit(False).alias("guest"))
    first = dealt.where(let(firsts, lambda f: F.get(f, F.col("range")) == key)).groupBy("range").agg(F.min_by(F.struct(*rows.columns, "hash"), F.struct("hash", "text")).alias("row"))
    guests = first.select("row.*", F.pmod(F.col("range") - 1, F.lit(len(starts))).alias("range"), F.lit(True).alias("guest"))
    return dealt.unionByName(guests).withColumn("next_text", F.lead("text").over(order_of_ranges()))


def order_of_ranges():
    return Window.partitionBy("range").orderBy("guest", "id", "hash", "text")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the characters replaced by the first as many of the following text."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    rows = with_next(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), ranges)
    spots = rows.withColumn("spots", signatures(F.col("text"))).withColumn("next_spots", F.lead("spots").over(order_of_ranges())).where("NOT guest")
    changed = spots.withColumn("changed", edited(F.col("text"), F.col("next_text")))
    own = changed.select("id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), "spots", "next_spots", signatures(F.col("changed")).alias("changed_spots"))
    return own.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("spots")).alias("fingerprint"), as_text(F.col("changed_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("changed_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )
