"""The corpus pipeline: toxicity, language, near-duplicates, repeated passages, packing.

Every stage takes all that the one before it kept, as Parquet. All but the last
return the columns of documents. Odd input is handled as the operators say;
columns that documents doesn't have pass through every stage but the last.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import jaccard_dedup, language_id, packing, toxicity, vocabularies, word_passages
from tallyforge.llm.common import free, learned_fold, short_batches, stored, table


def in_short_batches(stage):
    """The stage, whose texts go to Python workers in batches bounded in bytes; its result is still to be computed, so the session keeps the bound."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@in_short_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, fitted on the labels of the learning fold, doesn't predict toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(learned_fold(F.col("doc_id"))))
    [found] = free(docs, "toxicity")
    return toxicity.score(docs, model, out=found).where(F.col(found)["predicted"] == 0).select(*docs.columns)


@in_short_batches
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language."""
    model = language_id.learn(docs.where(learned_fold(F.col("doc_id"))))
    lang, score = free(docs, "lang_pred", "score")
    found = language_id.identify(docs, model, lang_pred=lang, score=score)
    return found.where(language_id.accepted(F.col(score), F.col(lang))).select(*docs.columns)


@in_short_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more of five-word shingles link: the one with the least id."""
    return jaccard_dedup.one_of_each(docs)


@in_short_batches
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that repeat; n_chars follows."""
    cut = word_passages.rewritten(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@in_short_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' token ids, packed into sequences."""
    return packing.packed(docs, vocabularies.ByteLevelBpe.read(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: Scores, hashes of shingles and the packing can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
